"""Reading and writing of files, and what imports make of them."""
