"""A PySpark engine for image-enhancement data and the ledgers around it."""
