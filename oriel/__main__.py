import sys

from oriel.cli import main

sys.exit(main())
