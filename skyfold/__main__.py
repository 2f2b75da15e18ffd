import sys

from skyfold.cli import main

sys.exit(main())
