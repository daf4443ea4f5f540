"""Delta debugging of tables, columns, tokens and JSON-like values.

The search is sequential by nature and runs on the driver; a predicate over a DataFrame may run Spark jobs.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed


@dataclass
class Evaluator:
    """A cached, budgeted predicate: trials with a quorum, evaluations and seconds at most.

    The predicate gives a truth value, or None where it can't tell (counted as unresolved, and taken for no). With
    `expected` it gives the failure that it saw (any value), or None for none, and only failures equal to the expected
    one count. What has been learnt is in `cache`, which another evaluator may begin with.
    """

    predicate: Callable[[Any], Any]
    trials: int = 1
    quorum: int | None = None
    max_evaluations: int | None = None
    max_seconds: float | None = None
    expected: Any = None
    evaluations: int = 0
    flaky: int = 0
    unresolved: int = 0
    cache: dict[str, bool] = field(default_factory=dict)
    began: float = field(default_factory=time.monotonic)

    @property
    def spent(self) -> bool:
        late = self.max_seconds is not None and time.monotonic() - self.began > self.max_seconds
        return late or (self.max_evaluations is not None and self.evaluations >= self.max_evaluations)

    def __call__(self, value: Any, key: Any = None) -> bool:
        name = json.dumps(value if key is None else key, sort_keys=True, default=repr)
        if name not in self.cache:
            if self.spent:
                return False
            hits = 0
            for _ in range(self.trials):
                self.evaluations += 1
                seen = self.predicate(value)
                self.unresolved += seen is None and self.expected is None
                hits += bool(seen) if self.expected is None else seen == self.expected
            self.flaky += 0 < hits < self.trials
            self.cache[name] = hits >= (self.quorum or self.trials)
        return self.cache[name]


def ddmin(items: Sequence[Any], predicate: Callable[[list[Any]], bool] | Evaluator, min_chunk: int = 1, **limits: Any) -> list[Any]:
    """A subsequence that still satisfies the predicate and of which no chunk of min_chunk items can be left out."""
    test = predicate if isinstance(predicate, Evaluator) else Evaluator(predicate, **limits)
    current = list(items)
    if not test(current):
        raise ValueError("the predicate does not hold for the whole input")
    chunk = max(min_chunk, (len(current) + 1) // 2)
    while len(current) > 1 or (current and chunk == min_chunk):
        at, removed = 0, False
        while at < len(current):
            trial = current[:at] + current[at + chunk :]
            if test(trial):
                current, removed = trial, True
            else:
                at += chunk
            if test.spent:
                return current
        if chunk == min_chunk and not removed:
            break
        chunk = max(min_chunk, min(chunk, (len(current) + 1) // 2) if removed else chunk // 2)
        if not current:
            break
    return current


#: Row numbers of a frame that is one task's work and isn't written again.
SMALL_FRAME = 100_000


def shrink_rows(df: DataFrame, predicate: Callable[[DataFrame], bool], row: str = "row_idx", **limits: Any) -> DataFrame:
    """ddmin over ranges of row numbers: a candidate is a filter, so rows never leave the cluster.

    The kept rows are a union of ranges, and each evaluation is one job over what was written last: the frame is written
    anew, and the former one's rows not read again, once half of its rows have gone.
    """
    held = checkpointed(df)
    low, high = held.agg(F.min(row), F.max(row)).first()
    if low is None:
        return df
    size = written = high - low + 1

    def frame(ranges: list[tuple[int, int]]) -> DataFrame:
        keep = F.lit(False)
        for a, b in _joined(ranges):
            keep = keep | F.col(row).between(a, b - 1)
        return held.where(keep)

    current, width = [(low, high + 1)], size
    test = Evaluator(lambda ranges: predicate(frame(ranges)), **limits)
    if not test(current):
        raise ValueError("the predicate does not hold for the whole table")
    while width > 1:
        width = max(1, width // 2)
        pieces = [(a, min(a + width, e)) for s, e in current for a in range(s, e, width)]
        current = _joined(ddmin(pieces, test))
        left = sum(b - a for a, b in current)
        if left <= written // 2 and written > SMALL_FRAME:
            kept = frame(current)
            held, written = checkpointed(kept if left > SMALL_FRAME else kept.repartition(1)), left
        if test.spent:
            break
    return frame(current)


def _joined(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, ranges)):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def shrink_columns(df: DataFrame, predicate: Callable[[DataFrame], bool], **limits: Any) -> DataFrame:
    """The fewest columns for which the predicate holds."""
    return df.select(*ddmin(df.columns, lambda c: bool(c) and predicate(df.select(*c)), **limits))


def shrink_tokens(text: str, predicate: Callable[[str], bool], **limits: Any) -> str:
    return " ".join(ddmin(text.split(), lambda t: predicate(" ".join(t)), **limits))


def shrink_sequence(items: Sequence[Any], requires: dict[int, Sequence[int]], predicate: Callable[[list[Any]], bool], **limits: Any) -> list[Any]:
    """ddmin that keeps, with an item, all that it requires (by index)."""

    def closed(kept: Sequence[int]) -> list[int]:
        todo, seen = list(kept), set()
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += requires.get(i, ())
        return sorted(seen)

    kept = ddmin(range(len(items)), lambda k: predicate([items[i] for i in closed(k)]), **limits)
    return [items[i] for i in closed(kept)]


def shrink_graph(nodes: Sequence[str], edges: Sequence[tuple[str, str]], predicate: Callable[[list[str], list[tuple[str, str]]], bool], **limits: Any) -> tuple[list[str], list[tuple[str, str]]]:
    """Fewest nodes, then edges; an edge goes with either of its ends."""
    inner = lambda n: [e for e in edges if e[0] in n and e[1] in n]
    n = ddmin(list(nodes), lambda kept: predicate(list(kept), inner(set(kept))), **limits)
    e = ddmin(inner(set(n)), lambda kept: predicate(n, list(kept)), **limits) if inner(set(n)) else []
    return n, e


def scalar_candidates(value: Any) -> list[Any]:
    """Simpler values of the same type, simplest first."""
    if isinstance(value, bool):
        return [False] if value else []
    if isinstance(value, int):
        return list(dict.fromkeys(v for v in (0, 1, -1, value // 2) if v != value and abs(v) <= abs(value)))
    if isinstance(value, float):
        return [v for v in (0.0, 1.0, -1.0, float(int(value)) if abs(value) < 1e15 else 0.0) if v != value]
    if isinstance(value, str):
        return list(dict.fromkeys(v for v in ("", value[:1], value[: len(value) // 2]) if v != value))
    return []


def shrink_structure(value: Any, predicate: Callable[[Any], bool], **limits: Any) -> Any:
    """A JSON-like value made smaller member by member and leaf by leaf."""
    test = Evaluator(predicate, **limits)
    if not test(value):
        raise ValueError("the predicate does not hold for the whole value")

    def step(now: Any, put: Callable[[Any], Any]) -> Any:
        if isinstance(now, dict):
            for key in sorted(now):
                without = {k: v for k, v in now.items() if k != key}
                if test(put(without)):
                    now = without
            for key in sorted(now):
                now = {**now, key: step(now[key], lambda v, k=key, n=now: put({**n, k: v}))}
        elif isinstance(now, list):
            now = ddmin(now, lambda kept: test(put(kept))) if now else now
            for i in range(len(now)):
                now = [*now[:i], step(now[i], lambda v, i=i, n=now: put([*n[:i], v, *n[i + 1 :]])), *now[i + 1 :]]
        else:
            now = next((c for c in scalar_candidates(now) if test(put(c))), now)
        return now

    before = None
    while before != value and not test.spent:
        before, value = value, step(value, lambda v: v)
    return value


def shrink_tabular(rows: list[dict[str, Any]], predicate: Callable[[list[dict[str, Any]]], bool], drop_columns: bool = False, **limits: Any) -> list[dict[str, Any]]:
    """Fewest rows, then (if allowed) fewest columns, then simpler cells."""
    test = Evaluator(predicate, **limits)
    rows = ddmin(rows, test)
    if drop_columns and rows:
        columns = ddmin(sorted({c for r in rows for c in r}), lambda kept: test([{c: r[c] for c in kept if c in r} for r in rows]))
        rows = [{c: r[c] for c in columns if c in r} for r in rows]
    for i in range(len(rows)):
        for c in sorted(rows[i]):
            for v in scalar_candidates(rows[i][c]):
                trial = [*rows[:i], {**rows[i], c: v}, *rows[i + 1 :]]
                if test(trial):
                    rows = trial
                    break
    return rows


def shrink_text(tokens: Sequence[str], spans: Sequence[tuple[int, int]], predicate: Callable[[list[str], list[tuple[int, int]]], bool], **limits: Any) -> tuple[list[str], list[tuple[int, int]]]:
    """Fewest tokens; spans (from, to) follow the tokens that are left, and a span's own tokens stay."""
    fixed = {i for a, b in spans for i in range(a, b)}

    def moved(kept: Sequence[int]) -> tuple[list[str], list[tuple[int, int]]]:
        place = {old: new for new, old in enumerate(kept)}
        return [tokens[i] for i in kept], [(place[a], place[b - 1] + 1) for a, b in spans]

    free = [i for i in range(len(tokens)) if i not in fixed]
    kept = ddmin(free, lambda k: predicate(*moved(sorted({*k, *fixed}))), **limits) if free else []
    return moved(sorted({*kept, *fixed}))


def shrink_tensor(value: Any, predicate: Callable[[Any], bool], preserve_shape: bool = True, **limits: Any) -> Any:
    """A NumPy array with shorter dimensions (unless the shape is to stay), more zeros, and smaller numbers."""
    import numpy as np

    test = Evaluator(predicate, **limits)
    key = lambda a: [a.shape, a.dtype.str, a.tobytes().hex()]
    ok = lambda a: test(a, key(a))
    now = np.array(value)
    if not ok(now):
        raise ValueError("the predicate does not hold for the whole tensor")
    if not preserve_shape:
        for axis in range(now.ndim):
            whole = now
            kept = ddmin(range(whole.shape[axis]), lambda k, w=whole, a=axis: len(k) > 0 and ok(np.take(w, list(k), axis=a)))
            now = np.take(whole, list(kept), axis=axis)
    flat = now.ravel()
    filled = np.flatnonzero(flat)

    def only(places: Sequence[int]) -> Any:
        out = np.zeros_like(flat)
        out[list(places)] = flat[list(places)]
        return out.reshape(now.shape)

    if len(filled):
        now = only(ddmin(filled.tolist(), lambda p: ok(only(p))))
    for simpler in (np.sign(now).astype(now.dtype), np.round(now).astype(now.dtype)):
        if ok(simpler):
            return simpler
    return now


def shrink_image(value: Any, predicate: Callable[[Any], bool], **limits: Any) -> Any:
    """A smaller crop of a (height, width[, channels]) array, fewer channels, then half resolution while it holds."""
    import numpy as np

    test = Evaluator(predicate, **limits)
    ok = lambda a: a.size > 0 and test(a, [a.shape, a.tobytes().hex()])
    now = np.array(value)
    if not ok(now):
        raise ValueError("the predicate does not hold for the whole image")
    for axis in (0, 1):
        step = now.shape[axis] // 2
        while step:
            n = now.shape[axis]
            for trial in (np.take(now, range(step, n), axis=axis), np.take(now, range(n - step), axis=axis)):
                if trial.shape[axis] and ok(trial):
                    now = trial
                    break
            else:
                step //= 2
    if now.ndim == 3:
        whole = now
        now = np.take(whole, ddmin(range(whole.shape[2]), lambda k: len(k) > 0 and ok(np.take(whole, list(k), axis=2))), axis=2)
    while min(now.shape[:2]) > 1 and ok(now[::2, ::2]):
        now = now[::2, ::2]
    return now


def shrink(value: Any, predicate: Callable[..., bool], kind: str = "auto", **options: Any) -> Any:
    """The strategy for a kind of value, or for what the value looks like."""
    if kind == "auto":
        kind = "table" if isinstance(value, DataFrame) else "tensor" if hasattr(value, "dtype") else "text" if isinstance(value, str) else "rows" if isinstance(value, list) else "structure"
    strategies = {"table": shrink_rows, "tensor": shrink_tensor, "image": shrink_image, "text": shrink_tokens, "rows": ddmin, "tabular": shrink_tabular, "structure": shrink_structure}
    return strategies[kind](value, predicate, **options)


def shrink_input(value: Any, predicate: Callable[[Any], bool], shrinker: Callable[[Any, Evaluator], Any] | None = None, max_steps: int = 64) -> tuple[Any, int]:
    """(a smaller value for which the predicate holds, evaluations): at most max_steps evaluations, of a shrinker of the
    caller's or of the strategy for the kind of value."""
    test = Evaluator(predicate, max_evaluations=max_steps)
    if not test(value):
        raise ValueError("the predicate does not hold for the value")
    best = [value]

    def holds(candidate: Any, key: Any = None) -> bool:
        ok = test(candidate, key)
        if ok:
            best[0] = candidate
        return ok

    if shrinker:
        shrinker(value, holds)
    elif isinstance(value, str):
        ddmin(value.split(), lambda words: holds(" ".join(words)), max_evaluations=max_steps)
    elif isinstance(value, list):
        ddmin(value, lambda items: holds(list(items)), max_evaluations=max_steps)
    elif hasattr(value, "dtype"):
        shrink_tensor(value, lambda a: holds(a, [a.shape, a.tobytes().hex()]), max_evaluations=max_steps)
    else:
        shrink_structure(value, holds, max_evaluations=max_steps)
    return best[0], test.evaluations


def shrink_capsule(source: str, target: str, predicate: Callable[[Any], bool], kind: str = "auto", member: str = "replay/inputs.json", verify: bool = True, key: bytes | None = None, **options: Any) -> dict[str, Any]:
    """Shrink the replay input of a capsule and write a child capsule that names its parent and how it came about.

    The child has all of the parent's members, the smaller input, and shrink.json: strategy, digests and sizes before
    and after, and whether the failure was seen again. Returns that record.
    """
    import hashlib

    from ..sources.capsules import canonical_json, read_capsule, strict_json, write_capsule

    rows = list(read_capsule(source, key=key))
    if rows[0][7]:
        raise ValueError(rows[0][7])
    members = {r[3]: r[6] for r in rows}
    if member not in members:
        raise ValueError(f"the capsule has no {member}")
    before = strict_json(members[member].decode())
    after = shrink(before, predicate, kind, **options)
    seen = bool(predicate(after)) if verify else None
    if seen is False:
        raise ValueError("the smaller input does not fail again")
    small = canonical_json(after).encode()
    record = {"parent": hashlib.sha256(members["manifest.json"]).hexdigest(), "member": member, "strategy": kind, "bytes_before": len(members[member]), "bytes_after": len(small), "sha256_before": hashlib.sha256(members[member]).hexdigest(), "sha256_after": hashlib.sha256(small).hexdigest(), "verified": seen}
    run = strict_json(members["run.json"].decode())
    history = [*strict_json(members["shrink.json"].decode())["history"], record] if "shrink.json" in members else [record]
    child = {**run, "run_id": f"{run.get('run_id')}-shrunk-{len(history)}", "parent_run_id": run.get("run_id")}
    kept = {n: d for n, d in members.items() if n not in ("run.json", "manifest.json", "signature.json")}
    write_capsule(target, child, {**kept, member: small, "shrink.json": canonical_json({"history": history}).encode()}, key=key)
    return record
