import pytest

from candlewick.llm import common


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of a few texts, so that small tables are dealt over many of them."""
    monkeypatch.setattr(common.blocks, "__defaults__", ("doc_id", "text", 2_000))
