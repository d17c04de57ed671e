"""What the keyed history asks of its store, per repository and batch."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Row

from patchwell.streaming.running import RepositoryState


class Store:
    """Stands in for the handle and its states; counts what is written."""

    def __init__(self):
        self.values, self.maps, self.writes = {}, {}, 0

    def getValueState(self, name, schema):
        store = self

        class Value:
            def get(self):
                return store.values.get(name)

            def update(self, value):
                assert len(value) == len(schema.split(", "))
                store.values[name], store.writes = value, store.writes + 1

        return Value()

    def getMapState(self, name, key, value):
        store = self

        class Map:
            def iterator(self):
                return iter(store.maps.items())

            def updateValue(self, key, value):
                store.maps[key], store.writes = value, store.writes + 1

        return Map()


REVIEW = Row("repo", "review_id", "ts", "score", "hits")


def review(n: int):
    hits = json.dumps([{"analyzer": "todos", "hits": 1, "seq": n}])
    return REVIEW("a", f"{n:06}", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n), 70 if n % 7 == 0 else 90, hits)


def given(keep: int):
    store, state = Store(), RepositoryState(85, keep)
    state.init(store)
    return store, state


def test_a_batch_writes_the_newest_reviews_at_once():
    store, state = given(50)
    for batch in (range(0, 300), range(290, 500)):  # ten arrive again
        store.writes = 0
        rows = list(state.handleInputRows(("a",), map(review, batch), None))
        assert store.writes == 3  # counters, newest, one analyzer
    assert [(r.review_id, r.streak, r.reviews) for r in rows] == [(f"{n:06}", n % 7, n + 1) for n in range(300, 500)]
    assert store.values["newest"][0] == [f"{n:06}" for n in range(450, 500)] and store.maps[("todos",)][0] == 500


def test_nothing_is_kept():
    store, state = given(0)
    assert [r.reviews for r in state.handleInputRows(("a",), map(review, range(3)), None)] == [1, 2, 3]
    assert store.values["newest"] == ([], [], [], [], [])
