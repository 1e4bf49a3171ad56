"""scoutflow: a PySpark engine that turns web pages and catalogues into ranked opportunity records."""
