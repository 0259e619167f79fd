"""Reading XML into node tables and typed rows, and writing it."""
