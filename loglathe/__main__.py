"""python -m loglathe."""

import sys

from .cli import main

sys.exit(main())
