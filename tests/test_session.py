"""What a driver keeps between two settled tables."""

from types import SimpleNamespace

import pytest

from sifthouse import session


@pytest.mark.parametrize("total, asked", [(300, 0), (400, 1), (750, 1)])
def test_a_grown_heap_is_collected(total, asked):
    """Over half of what the heap may take, and only then."""
    calls = []
    runtime = SimpleNamespace(totalMemory=lambda: total, maxMemory=lambda: 750)
    jvm = SimpleNamespace(System=SimpleNamespace(gc=lambda: calls.append(1)), java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime))))
    session.relieve(SimpleNamespace(_jvm=jvm))
    assert len(calls) == asked


def test_settling_relieves_the_driver(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(session, "relieve", lambda s: calls.append(s))
    session.discard(session.settle(spark.range(3)))
    assert calls == [spark]
