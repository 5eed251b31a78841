"""Reading labelled tables and writing results."""
