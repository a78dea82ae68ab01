from __future__ import annotations

from types import SimpleNamespace

import pandas as pd

from terravane.streaming import counters


class _Handle:
    """State of one id, with the number of calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return SimpleNamespace(get=self._get, update=self._update, clear=lambda: self._update(None))

    def _get(self):
        self.calls += 1
        return self.value

    def _update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)


def test_calls_of_the_state_do_not_grow_with_days_and_periods():
    handle, own = _Handle(), counters._Closing("id", 0, 6)
    own.init(handle)
    made = [(week * 100, f"w{week}", day, day + 1) for week in range(1, 6) for day in range(7)]
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: 450)
    for _ in range(2):
        list(own.handleInputRows(("a",), iter([pd.DataFrame(made, columns=["ends", "period", "day", "n"])]), times))
    assert handle.calls <= 6 and handle.timers == {100}
    (closed,) = own.handleExpiredTimer(("a",), times, SimpleNamespace(getExpiryTimeInMs=lambda: 100))
    assert [tuple(r) for r in closed.itertuples(index=False)] == [("a", f"w{week}", day, 2 * (day + 1)) for week in range(1, 5) for day in range(7)]
    assert handle.calls <= 9 and handle.timers == {100, 500} and set(handle.value[0]) == {500}
    assert not list(own.handleExpiredTimer(("a",), times, SimpleNamespace(getExpiryTimeInMs=lambda: 100)))
