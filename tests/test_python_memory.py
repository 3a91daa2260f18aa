"""What a task's Python holds at once."""

import pandas as pd
import pyarrow as pa

from loamgraph.functions import passages
from loamgraph.sources import files


class Rows:
    """Stands for a frame and runs what is mapped here."""

    def __init__(self, frame: pd.DataFrame):
        self.frame = frame

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):
        return list(run(iter([self.frame])))


def test_nodes_are_handed_on_a_few_at_a_time():
    n = 40
    source = ["# T\n\n" + "some words here. " * 8000] * (n - 2) + [None, ""]
    out = files.parsed(Rows(pd.DataFrame({"path": [f"p{i}.md" for i in range(n)], "source": source, "content_hash": ["h"] * n})))
    assert len(out) > 3 and [i for part in out for i in part.id] == [f"p{i}" for i in range(n)]
    assert files.parsed(Rows(pd.DataFrame({"path": [], "source": pd.Series([], dtype=object), "content_hash": []}))) == []


def test_chunks_of_many_texts(monkeypatch):
    made = []
    monkeypatch.setattr(passages.F, "arrow_udf", lambda kind: lambda run: made.append(run) or (lambda c: c))
    passages.chunks(None)
    texts = ["a b. " * i for i in range(200)] + [None, "", "é\n\n" * 3000]
    assert made[0](pa.array(texts)).to_pylist() == [passages.chunk(t) for t in texts]
    assert len(made[0](pa.array([], pa.string()))) == 0
