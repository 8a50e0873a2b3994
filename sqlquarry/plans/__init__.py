"""Planning of mined queries against mock tables, in sessions of their own."""
