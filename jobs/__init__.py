"""Jobs with a command line each; ``queries`` registers them."""
