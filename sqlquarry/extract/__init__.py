"""String literals of source code, and the SQL among them."""
