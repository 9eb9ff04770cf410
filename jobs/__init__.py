"""Jobs that are run from a command line: ``python -m jobs.<name> --config jobs/<name>.json``."""
