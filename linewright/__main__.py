"""python -m linewright COMMAND ..."""

import sys

from linewright.cli.commands import main

sys.exit(main(sys.argv[1:]))
