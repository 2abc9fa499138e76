import sys

from fairloom.cli import main

sys.exit(main())
