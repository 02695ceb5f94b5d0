"""Column-level functions: names, vocabularies, parameters, scores, calendar."""
