"""Search over structured catalogs and evaluation of ranking systems, on Spark."""
