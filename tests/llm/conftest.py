from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_fixtures import byte_vocabulary, nothing, odd, shipped, word_vocabulary  # noqa: E402, F401
