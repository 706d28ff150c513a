"""Column functions: URLs, HTML, robots.txt, scalars."""
