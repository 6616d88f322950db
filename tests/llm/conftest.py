import pytest

pytest.importorskip("wayfare.llm")
