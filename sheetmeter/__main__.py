import sys

from sheetmeter.cli import main

sys.exit(main())
