import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from compare_sql import compare  # noqa: E402

from rescora.llm.oracles import ORACLES  # noqa: E402
from rescora.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


def test_all_operators():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
