"""A PySpark engine that scales texts on bipolar axes, and the tables around it."""
