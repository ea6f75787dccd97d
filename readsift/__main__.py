import sys

from readsift.plans.cli import main

sys.exit(main())
