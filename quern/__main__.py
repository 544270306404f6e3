import sys

from quern.cli import main

sys.exit(main())
