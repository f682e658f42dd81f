"""The command line: python -m beliefmesh COMMAND ... (see `commands`)."""

from beliefmesh.cli import main

if __name__ == "__main__":
    raise SystemExit(main())
