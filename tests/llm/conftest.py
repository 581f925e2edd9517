import sys
from pathlib import Path

# Helpers of the other tests.
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
