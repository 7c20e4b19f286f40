"""Nothing streams: all inputs of the methods here are finite files and tables, so every plan is a batch plan."""
