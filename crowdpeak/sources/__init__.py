"""Reading and writing the tables of the engine."""
