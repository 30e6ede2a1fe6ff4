"""URL filters: all glob rules run at once over each canonical URL by a bit-parallel automaton.

The canonical URL is ``.`` + host + path, in UTF-8. A rule is a glob over the whole of it: ``*`` is any run of bytes but
``/``, ``**`` any run, ``?`` one byte but ``/``, and a backslash makes the next character plain. Every rule owns a run
of bits in a row of 64-bit words: one for its start and one for each byte it consumes. For each byte of the URL the
states of all rules move together: shift by one (the top bit of a word carries into the next), keep what the byte
admits, and keep what a star lets stay. Many URLs are advanced side by side; those that end leave the front.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlake.llm.common import passed, ready, utf8

ROWS = 4_096  # URLs advanced together
STATES = 1 << 22  # words of state held at once
ONE = np.uint64(1)


class Rule(NamedTuple):
    """What to answer where a glob fits; ``name`` is reported as the rule, null where None."""

    verdict: str
    glob: str
    name: str | None = None


def plain(text: str) -> str:
    """The text as a glob that fits only itself."""
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def site_rules(listed: Sequence[tuple[str, str]]) -> list[Rule]:
    """Rules ``host/path`` for a host with all its subdomains and the paths that start so; the longest comes first."""
    order = sorted(listed, key=lambda r: (-len(r[1]), -len(r[1].split("/", 1)[0]), r[1]))
    return [Rule(verdict, f"*.{plain(rule)}**", rule) for verdict, rule in order]


def host_rules(verdict: str, glob: str) -> list[Rule]:
    """Rules for hosts that fit the glob, under any path or none."""
    return [Rule(verdict, f".{glob}"), Rule(verdict, f".{glob}/**")]


def parsed(glob: str) -> list[tuple[str, int]]:
    """The glob as byte, one, star and run elements."""
    out, data, i = [], glob.encode(), 0
    while i < len(data):
        c = chr(data[i])
        if c == "\\" and i + 1 < len(data):
            out.append(("byte", data[i + 1]))
            i += 2
        elif c == "*":
            stars = 1
            while data[i + stars:i + stars + 1] == b"*":
                stars += 1
            out.append(("run" if stars > 1 else "star", 0))
            i += stars
        else:
            out.append(("one", 0) if c == "?" else ("byte", data[i]))
            i += 1
    return out


class Automaton:
    """The masks of all globs; ``first`` gives the first glob that fits each text, -1 where none does."""

    def __init__(self, globs: Sequence[str]):
        elements = [parsed(g) for g in globs]
        sizes = [1 + sum(kind in ("byte", "one") for kind, _ in e) for e in elements]
        self.words = max(1, -(-sum(sizes) // 64))
        admit, stay = np.zeros((256, 64 * self.words), bool), np.zeros((256, 64 * self.words), bool)
        not_slash = np.arange(256) != ord("/")
        start, last, bit = np.zeros(64 * self.words, bool), np.zeros(64 * self.words, bool), 0
        for e in elements:
            start[bit] = True
            for kind, byte in e:
                if kind == "byte":
                    bit += 1
                    admit[byte, bit] = True
                elif kind == "one":
                    bit += 1
                    admit[not_slash, bit] = True
                else:
                    stay[:, bit] |= not_slash if kind == "star" else True
            last[bit] = True
            bit += 1
        pack = lambda bits: np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)
        self.admit, self.stay, self.start, self.last = pack(admit), pack(stay), pack(start), pack(last)
        self.rule_of = np.repeat(np.arange(len(globs)), sizes)

    def states(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """State words after each whole text; rows must come longest first."""
        begin, lengths = offsets[:-1], np.diff(offsets)
        state = np.tile(self.start, (len(lengths), 1))
        active = len(lengths)
        for at in range(int(lengths.max(initial=0))):
            active = int(np.searchsorted(-lengths[:active], -at, "left"))
            byte, now = data[begin[:active] + at], state[:active]
            moved = now << ONE
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.admit[byte]
            now &= self.stay[byte]
            now |= moved
        return state

    def first(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, -1, np.int64)
        order = np.argsort(-np.diff(offsets), kind="stable")
        rows = max(1, min(ROWS, STATES // self.words))
        for a in range(0, len(order), rows):
            some = order[a:a + rows]
            size = np.diff(offsets)[some]
            cuts = np.concatenate([[0], np.cumsum(size)])
            source = np.repeat(offsets[:-1][some] - cuts[:-1], size) + np.arange(cuts[-1])
            fits = self.states(data[source], cuts) & self.last
            hit = np.flatnonzero(fits.any(axis=1))
            if len(hit):
                bits = np.unpackbits(fits[hit].view(np.uint8), axis=1, bitorder="little")
                out[some[hit]] = self.rule_of[bits.argmax(axis=1)]
        return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("page_id",), url: str = "url", otherwise: str = "allow") -> DataFrame:
    """The columns of ``keep``, then ``host``, ``path``, ``rule``, ``verdict`` and ``glob``.

    The first rule that fits decides; ``rule`` is its name and ``glob`` its glob. Where none fits, the verdict is
    ``otherwise`` and both are null. A null url or one without ``://`` has an empty host and path, so only rules that
    fit a lone ``.`` judge it. URLs of any length are read whole; equal rows are judged alike, each on its own; other
    columns do not matter, whatever their names. No rules and no rows are allowed.
    """
    ready(pages.sparkSession)
    host, path = url_parts(F.col(url).cast("string"))
    urls = pages.select(*keep, host.alias("host"), path.alias("path"))
    globs = [r.glob for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for batch in batches:
            texts = [f".{h}{p}" for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            hit = automaton.first(*utf8(pa.array(texts, pa.string())))
            look = lambda values, none: pa.array([none if h < 0 else values[h] for h in hit.tolist()], pa.string())
            yield passed(batch, [], {
                "rule": look([r.name for r in rules], None), "verdict": look([r.verdict for r in rules], otherwise), "glob": look(globs, None),
            })

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.mapInArrow(run, f"{schema}, rule string, verdict string, glob string")
