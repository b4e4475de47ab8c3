"""PySpark jobs that measure how generated text follows a requested position between two styles."""
