"""Persistent ids of one corpus in plain Python, against which the steps of joins are held."""

from __future__ import annotations

import pyarrow as pa

from driftloom.operators.lineage import STRONG


def fold(table: pa.Table) -> pa.Table:
    """The ids of one corpus; rows: kind (cluster, seed, pair, split, back), period, c, parent, gap, score, lineage."""
    by: dict[str, dict[int, list[dict]]] = {}
    for r in table.to_pylist():
        by.setdefault(r["kind"], {}).setdefault(r["period"], []).append(r)
    of = lambda kind, p: by.get(kind, {}).get(p, [])
    ids: dict[int, dict[int, str]] = {p: {r["c"]: r["lineage"] for r in rows} for p, rows in by.get("seed", {}).items()}
    known = [int(x) for own in ids.values() for x in own.values() if x.isdigit()]
    count, rows = max(known, default=-1) + 1, []

    def new() -> str:
        nonlocal count
        count += 1
        return f"{count - 1:06d}"

    for p in sorted(by.get("cluster", {})):
        last, done = ids.get(p - 1, {}), {}
        first = p - 1 not in ids
        parted = {(r["parent"], r["c"]): r for r in of("split", p)}
        for r in sorted(parted.values(), key=lambda r: (-r["score"], r["parent"], r["c"])):
            if r["c"] not in done and r["parent"] in last:
                done[r["c"]] = (last[r["parent"]], "split_child", r["parent"], r["score"], 1)
        sources = {a for a, _ in parted}
        child: dict[int, tuple] = {}
        for r in sorted(of("pair", p), key=lambda r: (-r["score"], r["parent"])):
            if r["c"] not in done and r["parent"] not in sources and r["parent"] in last:
                child.setdefault(r["c"], (r["score"], r["parent"]))
        claims: dict[str, list[tuple]] = {}
        taken: set[int] = set()
        for c, (score, parent) in sorted(child.items(), key=lambda x: (-x[1][0], x[0])):
            if parent not in taken:
                taken.add(parent)
                claims.setdefault(last[parent], []).append((score, c, "continuation" if score >= STRONG else "weak", parent, 1))
        won = {x[1] for own in claims.values() for x in own}
        alive, best = set(last.values()), {}
        for r in sorted(of("back", p), key=lambda r: (-r["score"], r["gap"], r["parent"])):
            lineage_of = ids.get(p - r["gap"], {}).get(r["parent"])
            if r["c"] not in done and r["c"] not in won and lineage_of is not None and lineage_of not in alive:
                best.setdefault(r["c"], (r["score"], r["c"], "reborn", r["parent"], r["gap"], lineage_of))
        for *claim, lineage_of in best.values():
            claims.setdefault(lineage_of, []).append(tuple(claim))
        for lineage_of, own in claims.items():
            score, c, kind, parent, gap = min(own, key=lambda x: (-x[0], x[1]))
            done[c] = (lineage_of, kind, parent, score, gap)
        for r in sorted(of("cluster", p), key=lambda r: r["c"]):
            got = done.get(r["c"]) or (new(), "new", None, None, None)
            ids.setdefault(p, {})[r["c"]] = got[0]
            rows.append((p, r["c"], got[0], got[1] if not first or got[1] != "new" else "new", *got[2:]))
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int32()]
    corpus = pa.array([table.column("corpus")[0].as_py()] * len(rows), pa.string())
    return pa.table([corpus, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["corpus", "period", "c", "lineage", "match_type", "parent", "score", "gap"])
