"""Domain tables projected from the supplied test tables, and the SQL that checks the operators."""
