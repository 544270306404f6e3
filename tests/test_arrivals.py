"""Entities of names that arrive in batches: as of one run over all, and nothing signed twice."""

from quern.operators import entities
from quern.operators.arrivals import Arrivals

BATCHES = [
    [(10, "kubernetes-deploy-helper"), (11, "docker image builder"), (12, "abc"), (13, "postgres backup tool")],
    [(3, "Kubernetes Deploy Helper"), (14, "docker image builders"), (15, "ABC!"), (16, "postgres backup tool"), (17, "unrelated name here")],
    [(1, "KUBERNETES_DEPLOY_HELPER"), (18, "kubernetes deploy helpers"), (19, ""), (20, "docker image bulider")],
]


def test_three_arrivals(spark, tmp_path, monkeypatch):
    store, signed = Arrivals(spark, f"{tmp_path}/store"), []
    real = entities.signatures
    monkeypatch.setattr(entities, "signatures", lambda names, *a: signed.append({r.name for r in names.collect()}) or real(names, *a))
    frame = lambda rows: spark.createDataFrame(rows, "rowid long, name string")
    for k, rows in enumerate(BATCHES):
        store.add(frame(rows), k)
        so_far = [r for b in BATCHES[: k + 1] for r in b]
        assert signed[-1] == {n for _, n in rows} - {n for b in BATCHES[:k] for _, n in b}
        with monkeypatch.context() as m:
            m.setattr(entities, "signatures", real)
            want = {(r.rowid, r.name, r.survivor) for r in entities.survivors(frame(so_far)).collect()}
        assert {tuple(r) for r in store.survivors().collect()} == want
    again = {tuple(r) for r in store.survivors().collect()}
    store.add(frame(BATCHES[1]), 1)
    assert {tuple(r) for r in store.survivors().collect()} == again and len({s for *_, s in again}) < len(again)
