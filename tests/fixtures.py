"""A small catalogue in the shape the loaders expect."""

MOLECULES = [
    ("MOL001", "Amoxycillin", "small_molecule"), ("MOL002", "metformin", "small_molecule"), ("MOL003", "atorvastatin", "small_molecule"),
    ("MOL004", "warfarin", "small_molecule"), ("MOL005", "aspirin", "small_molecule"), ("MOL006", "omeprazole", "small_molecule"),
    ("MOL007", "hydroxyzine", "small_molecule"), ("MOL008", "clopidogrel", "small_molecule"), ("MOL009", "amlodipine", "small_molecule"),
    ("MOL010", "prednisolone", "small_molecule"), ("MOL011", "prednisone", "small_molecule"), ("MOL012", "salbutamol", "small_molecule"),
    ("MOL013", "levothyroxine", "small_molecule"), ("MOL014", "clavulanic acid", "small_molecule"), ("MOL015", "insulin glargine", "biologic"),
]
ALIASES = [
    ("Acetylsalicylic Acid", "acetylsalicylic acid", "rxnorm_dump", "MOL005"), ("Ecosprin", "ecosprin", "manual", "MOL005"),
    ("Mox", "mox", "manual", "MOL001"), ("Glycomet", "glycomet", "manual", "MOL002"), ("Atorva", "atorva", "manual", "MOL003"),
    ("Albuterol", "albuterol", "rxnorm_dump", "MOL012"), ("Wysolone", "wysolone", "manual", "MOL010"), ("Ghost", "ghost", "manual", "MOL999"),
]
PRODUCTS = [
    ("PRD001", "PMBJP", "Amoxicillin 500mg Capsule", "capsule", "32.50"), ("PRD002", "branded_csv", "Novamox 500 Capsule", "capsule", "98.00"),
    ("PRD003", "branded_csv", "Mox 500 Capsule", "capsule", "112.00"), ("PRD004", "PMBJP", "Amoxicillin 250mg Capsule", "capsule", "20.00"),
    ("PRD010", "PMBJP", "Metformin 500mg Tablet", "tablet", "8.00"), ("PRD011", "branded_csv", "Glycomet 500 Tablet", "tablet", "24.00"),
    ("PRD012", "branded_csv", "Metformin Hydrochloride 0.5g Tablet", "tablet", "31.00"), ("PRD030", "PMBJP", "Aspirin 75mg Tablet", "tablet", "0.00"),
    ("PRD031", "branded_csv", "Ecosprin 75 Tablet", "tablet", "11.50"), ("PRD040", "branded_csv", "Amoxicillin and Clavulanic Acid Tablet", "tablet", "145.00"),
    ("PRD050", "PMBJP", "Salbutamol 100mcg Inhaler", "inhaler", "142.00"), ("PRD060", "PMBJP", "Unknown", None, "5.00"),
]
CONTAINS = [
    ("PRD001", "MOL001", 500.0, "mg"), ("PRD002", "MOL001", 500.0, "mg"), ("PRD003", "MOL001", 500.0, "mg"), ("PRD004", "MOL001", 250.0, "mg"),
    ("PRD010", "MOL002", 500.0, "mg"), ("PRD011", "MOL002", 500.0, "mg"), ("PRD012", "MOL002", 0.5, "g"), ("PRD030", "MOL005", 75.0, "mg"),
    ("PRD031", "MOL005", 75.0, "mg"), ("PRD040", "MOL001", 500.0, "mg"), ("PRD040", "MOL014", 125.0, "mg"), ("PRD050", "MOL012", 100.0, "mcg"),
]
COMBINATIONS = [
    ("", "Augmentin", "MOL014", "clavulanic acid", 2), ("", "Augmentin", "MOL001", "amoxicillin", 1),
    ("", "Halfpack", "MOL001", "amoxicillin", 1), ("", "Halfpack", "MOL777", "nothing", 2), ("", "Single", "MOL001", "amoxicillin", 1),
]
EDGES = [
    ("MOL005", "MOL004", "major", "bleeding.", "ddinter"), ("MOL004", "MOL008", "major", None, "ddinter"), ("MOL010", "MOL002", "moderate", None, "ddinter"),
    ("MOL003", "MOL014", "minor", None, "ddinter"),
]
GROUPS = dict(zip([m[0] for m in MOLECULES], "JACBBANBCHHRHJA"))
BLOCKLIST = [("prednisolone", "prednisone"), ("Hydralazine", "hydroxyzine"), ("omeprazol", "Omeprazole")]


def numbered(spark, rows, schema):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", row_no bigint")


def catalogue(spark):
    from pyspark.sql import functions as F

    from rxlake.operators import fuzzy, vocab
    from rxlake.plans.resolve import Vocabulary

    molecules = vocab.load_molecules(spark.createDataFrame(MOLECULES, "molecule_id string, inn_name string, category string"))
    aliases = vocab.load_aliases(numbered(spark, ALIASES, "raw_string string, normalized_string string, source string, molecule_id string"))
    combos = numbered(spark, [(*c, "brand") for c in COMBINATIONS], "brand_key string, brand_raw string, molecule_id string, inn_name string, position int, kind string")
    pairs = fuzzy.blocklist_pairs(spark.createDataFrame(BLOCKLIST, "molecule_a string, drug_b string"))
    products = spark.createDataFrame(PRODUCTS, "product_id string, source string, generic_name_raw string, form string, mrp string").withColumn("mrp", F.col("mrp").cast("decimal(12,2)"))
    contains = spark.createDataFrame(CONTAINS, "product_id string, molecule_id string, strength double, unit string")
    edges = spark.createDataFrame(EDGES, "molecule_id_a string, molecule_id_b string, severity string, mechanism string, provenance string").withColumn("row_no", F.lit(0))
    coverage = spark.createDataFrame(list(GROUPS.items()), "molecule_id string, atc_group string")
    vocabulary = Vocabulary(molecules, aliases, vocab.combination_index(combos, ["row_no"]), pairs, ["row_no"])
    return vocabulary, products, contains, edges, coverage
