import sys

from stratalith.cli import main

sys.exit(main())
