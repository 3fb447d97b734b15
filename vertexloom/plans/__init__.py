"""What is declared: graphs over tables and queries over graphs."""
