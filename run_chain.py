"""Launcher for the artifact chain: ``spark-submit run_chain.py --input DIR
--output SHARED_DIR --start EPOCH [--days 21] [--rounds 465]``.

The package ships itself to the executors (``session.ship_package``)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bandcast.jobs import main  # noqa: E402

if __name__ == "__main__":
    main()
