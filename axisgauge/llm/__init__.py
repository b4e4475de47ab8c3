"""Training-data operators: ten jobs over whole document tables, one module each, and their registered queries."""
