"""Stateful processors for ``transformWithStateInPandas``, one key per session.

Micro-batches cut a stream anywhere, and files or partitions arrive in any order.  An ``OrderedProcessor`` therefore holds
rows until the watermark has passed them and then takes them in event order, so its output does not depend on the cuts.
Run it in event-time mode on a stream with a watermark on ``at``; what it holds is bounded by the watermark's delay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from sonorisk.operators.context import transcript_rows
from sonorisk.operators.temporal import FACTORS, TIMELINE_FIELDS, SessionFold, timeline_frame

BLOB = StructType([StructField("v", StringType())])


def _plain(v):
    return v.item() if hasattr(v, "item") else str(v)


class OrderedProcessor(StatefulProcessor):
    """Rows of a key in event order, with one JSON value as state.

    ``take`` gets the columns (name to list of values) of rows that the watermark has passed, sorted by ``at`` and ``order``;
    Spark drops rows that arrive behind it.  With ``idle_ms``, ``closed`` is called once no row has come for that long, and the
    state is dropped.  What a batch brings is held as one value, column by column.
    """

    order: tuple[str, ...] = ()
    idle_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", BLOB)
        self.held = handle.getListState("held", BLOB)

    def take(self, key, rows: dict[str, list], state: dict) -> tuple[pd.DataFrame | None, dict]:
        raise NotImplementedError

    def closed(self, key, state: dict) -> pd.DataFrame | None:
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if len(pdf):
                columns = {c: pdf[c].tolist() for c in pdf.columns if c != "at"}
                columns["at_ms"] = pdf["at"].to_numpy().astype("datetime64[ms]").astype("int64").tolist()
                self.held.appendValue((json.dumps(columns, default=_plain),))
                self.handle.registerTimer(min(columns["at_ms"]) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, state = timerValues.getCurrentWatermarkInMs(), self._load()
        self.now_ms = now
        parts = [json.loads(x[0]) for x in self.held.get()] if self.held.exists() else []
        rows = {c: [v for p in parts for v in p[c]] for c in parts[0]} if parts else {"at_ms": []}
        at = rows["at_ms"]
        ready, rest = [k for k, t in enumerate(at) if t < now], [k for k, t in enumerate(at) if t >= now]
        if ready:
            by = [at, *(rows[c] for c in self.order)]
            ready.sort(key=lambda k: tuple(c[k] for c in by))
            out, state["v"] = self.take(key, {c: [v[k] for k in ready] for c, v in rows.items()}, state.get("v") or {})
            state["last_ms"] = at[ready[-1]]
            if out is not None and len(out):
                yield out
            if rest:
                self.held.put([(json.dumps({c: [v[k] for k in rest] for c, v in rows.items()}),)])
                self.handle.registerTimer(min(at[k] for k in rest) + 1)
            else:
                self.held.clear()
        if self.idle_ms is not None and not rest and "last_ms" in state:
            if state["last_ms"] + self.idle_ms < now:
                out = self.closed(key, state.get("v") or {})
                self.state.clear()
                if out is not None and len(out):
                    yield out
                return
            self.handle.registerTimer(state["last_ms"] + self.idle_ms + 1)
        self._save(state)

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {}

    def _save(self, state: dict) -> None:
        if state:
            self.state.update((json.dumps(state, default=_plain),))

    def close(self) -> None:
        pass


RISK_FIELDS = TIMELINE_FIELDS + ", rank long, factor string, weight double, direction string"
RISK_COLUMNS = [f.strip().split(" ")[0] for f in RISK_FIELDS.split(",")]


def _risk_frame(rows: pd.DataFrame) -> pd.DataFrame:
    """All columns of the session operator; texts as plain objects, so that a column of NULLs converts."""
    out = rows.reindex(columns=RISK_COLUMNS)
    return out.astype(dict.fromkeys(("state", "factor", "direction"), object))


class SessionRiskProcessor(OrderedProcessor):
    """Fused windows in, timeline rows out, by the same fold as in batch; at the close the drivers of the session.

    The state carries the accumulated contributions of each head.  A driver row has a rank and no window.
    """

    order, top, elevated = ("window_id",), 3, 0.40

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def take(self, key, rows, state):
        f = SessionFold.restore(state["f"]) if state else SessionFold()
        out = f.run(rows["window_id"], [None if p is None or p != p else p for p in rows["p_fused"]])
        sums = state.get("sums", {})
        for h in FACTORS:
            terms = [v for v in rows.get(f"signed_{h}", ()) if v is not None and v == v]
            if terms:
                size, net = sums.get(h, (0.0, 0.0))
                sums[h] = (size + sum(map(abs, terms)), net + sum(terms))
        return _risk_frame(timeline_frame(key[0], out)), {"f": f.dump(), "sums": sums, "p_hmm": out[-1][2]}

    def closed(self, key, state):
        f, sums = SessionFold.restore(state["f"]), state["sums"]
        total = sum(size for size, _ in sums.values())
        ranked = sorted(((size, h, net) for h, (size, net) in sums.items()), reverse=True)[: self.top] if total > 0 else []
        rows = [(k, FACTORS[h], size / total, "towards synthetic" if net > 0 else "towards genuine") for k, (size, h, net) in enumerate(ranked, 1)]
        if f.peak_window is not None and f.peak > state["p_hmm"] and f.peak >= self.elevated:
            rows.append((self.top + 1, "any_segment_trigger", f.peak, f"window {f.peak_window}"))
        out = pd.DataFrame(rows, columns=["rank", "factor", "weight", "direction"])
        return _risk_frame(out.assign(session_id=key[0]))


class DecisionProcessor(OrderedProcessor):
    """A decision row when the state enters ELEVATED or HIGH, when the label set changes, and at the close."""

    order, idle_ms = ("window_id",), 60_000
    columns = ["session_id", "window_id", "state", "reason"]

    def take(self, key, rows, state):
        before, labels, out, last = state.get("state"), state.get("labels", ""), [], None
        for w, st, lab in zip(rows["window_id"], rows["state"], rows["labels"], strict=True):
            reason = "state" if st != before and st in ("ELEVATED", "HIGH") else "labels" if lab != labels else None
            if reason:
                out.append((key[0], w, st, reason))
            before, labels, last = st, lab, [w, st, reason]
        return pd.DataFrame(out, columns=self.columns), {"state": before, "labels": labels, "last": last}

    def closed(self, key, state):
        w, st, reason = state["last"]
        return None if reason else pd.DataFrame([(key[0], w, st, "close")], columns=self.columns)


def play_out(pending: list[int], due: int, depth: int, conceal: int, drain: bool = False) -> tuple[list[tuple[int, str]], list[int], int]:
    """Frames that can be played from the pending packets (ascending, distinct, none before ``due``).

    The packets split into runs of neighbours.  The run that begins at ``due`` plays; a run behind a gap waits until
    ``depth`` packets are pending, the gap is wider than ``depth``, or the stream drains.  Up to ``conceal`` frames of a
    gap are concealed, the rest skipped.  Returns (frames, still pending, next due).
    """
    frames: list[tuple[int, str]] = []
    k = 0
    while k < len(pending):
        gap = pending[k] - due
        if gap and not drain and len(pending) - k < depth and gap <= depth:
            break
        frames += [(due + j, "concealed") for j in range(min(gap, conceal))]
        end = k + 1
        while end < len(pending) and pending[end] == pending[end - 1] + 1:
            end += 1
        frames += [(n, "frame") for n in pending[k:end]]
        due, k = pending[end - 1] + 1, end
    return frames, pending[k:], due


class ReorderProcessor(OrderedProcessor):
    """Put packets back in sequence: hold up to ``depth``, mark late ones, conceal short gaps, drain at the close."""

    order, idle_ms = ("seq",), 60_000
    depth, conceal = 20, 5
    columns = ["session_id", "seq", "kind"]

    def take(self, key, rows, state):
        due, pending, late, hidden, out = state.get("due"), state.get("pending", []), state.get("late", 0), state.get("hidden", 0), []
        for seq in rows["seq"]:
            due = seq if due is None else due
            if seq < due:
                late += 1
                out.append((seq, "late"))
            elif seq not in pending:
                frames, pending, due = play_out(sorted([*pending, seq]), due, self.depth, self.conceal)
                hidden += sum(kind == "concealed" for _, kind in frames)
                out += frames
        return pd.DataFrame([(key[0], *x) for x in out], columns=self.columns), {"due": due, "pending": pending, "late": late, "hidden": hidden}

    def closed(self, key, state):
        frames, _, _ = play_out(state["pending"], state["due"], self.depth, self.conceal, drain=True)
        hidden = state["hidden"] + sum(kind == "concealed" for _, kind in frames)
        return pd.DataFrame([(key[0], *x) for x in [*frames, (state["late"], "late_total"), (hidden, "concealed_total")]], columns=self.columns)


class TranscriptProcessor(OrderedProcessor):
    """Rolling transcript: accepted final segments of the last two minutes."""

    order, keep_ms = ("start_ms", "end_ms"), 120_000

    def take(self, key, rows, state):
        done, held = transcript_rows(state.get("held", []), rows["start_ms"], rows["end_ms"], [len(t or "") for t in rows["text"]], self.keep_ms)
        return pd.DataFrame([(key[0], s, taken, n) for s, (taken, n, _) in zip(rows["start_ms"], done, strict=True)], columns=["session_id", "start_ms", "accepted", "n_held"]), {"held": held}


class TokenBucketProcessor(OrderedProcessor):
    """Requests per key against a refilling token bucket."""

    order = ("ts_us", "event_id")
    rate_per_s, burst = 1 / 3600, 5.0

    def take(self, key, rows, state):
        tokens, at, out = state.get("tokens", self.burst), state.get("at"), []
        for t, e in zip(rows["ts_us"], rows["event_id"], strict=True):
            if at is not None:
                tokens = min(self.burst, tokens + (t - at) / 1e6 * self.rate_per_s)
            at, ok = t, tokens >= 1
            tokens -= ok
            out.append((key[0], e, ok))
        return pd.DataFrame(out, columns=["key_id", "event_id", "allowed"]), {"tokens": tokens, "at": at}


class ShortReferenceProcessor(OrderedProcessor):
    """References that live 30 s of event time: a lookup finds the sample only while the reference is alive."""

    order, idle_ms, live_us = ("ts_us", "event_id"), 30_000, 30_000_000

    def take(self, key, rows, state):
        at, out = state.get("at"), []
        for t, e, op in zip(rows["ts_us"], rows["event_id"], rows["op"], strict=True):
            if op == "put":
                at = t
            else:
                out.append((key[0], e, at is not None and t - at <= self.live_us))
        return pd.DataFrame(out, columns=["ref", "event_id", "found"]), {"at": at}


class ChallengeProcessor(OrderedProcessor):
    """One active challenge per session; an answer counts only for the active one, in time."""

    ttl_us = 30_000_000

    def take(self, key, rows, state):
        active, out = state.get("active"), []
        events = sorted(zip(rows["ts_us"], rows["kind"], rows["challenge_id"], strict=True), key=lambda e: (e[0], e[1] == "answer", e[2]))
        for t, kind, c in events:
            if kind == "issue":
                if active and not active["done"]:
                    out.append((key[0], active["id"], "replaced" if t - active["at"] <= self.ttl_us else "expired"))
                active = {"id": c, "at": t, "done": False}
            elif not active or active["id"] != c:
                out.append((key[0], c, "not_active"))
            else:
                out.append((key[0], c, "answered" if t - active["at"] <= self.ttl_us else "late"))
                active["done"] = True
        return pd.DataFrame(out, columns=["session_id", "challenge_id", "outcome"]), {"active": active}


class EnrichmentProcessor(OrderedProcessor):
    """Slow enrichment, at most every ten seconds per session: rows that should start a run."""

    order, every_us = ("ts_us", "event_id"), 10_000_000

    def take(self, key, rows, state):
        last, out = state.get("last"), []
        for t, e in zip(rows["ts_us"], rows["event_id"], strict=True):
            if last is None or t - last >= self.every_us:
                last = t
                out.append((key[0], e))
        return pd.DataFrame(out, columns=["session_id", "event_id"]), {"last": last}


class IdleSessionProcessor(OrderedProcessor):
    """Session lifecycle by event time: a session idle for the TTL ends with one terminal row."""

    order, idle_ms = ("ts_us",), 60_000
    columns = ["session_id", "first_ms", "last_ms", "n"]

    def take(self, key, rows, state):
        first, last, n, out = state.get("first"), state.get("last"), state.get("n", 0), []
        for t in rows["at_ms"]:
            if first is not None and t - last >= self.idle_ms:
                out.append((key[0], first, last, n))
                first, n = None, 0
            first, last, n = t if first is None else first, t, n + 1
        return pd.DataFrame(out, columns=self.columns), {"first": first, "last": last, "n": n}

    def closed(self, key, state):
        return pd.DataFrame([(key[0], state["first"], state["last"], state["n"])], columns=self.columns)


class ArrivalProcessor(OrderedProcessor):
    """Lateness by arrival: rows of a run of arrival numbers, each with the greatest event time that came before it in the run.

    The event time of this operator is the arrival number.  A run's last row, without an event, holds its greatest event time,
    from which later runs learn what came before them.
    """

    order = ("arrival",)
    columns = ["run", "event_id", "event_type", "ts_us", "high_us"]

    def __init__(self, run_length: int):
        self.idle_ms = 1000 * run_length  # an arrival number is a second, so the run is over by then

    def take(self, key, rows, state):
        high, out = state.get("high"), []
        for e, kind, t in zip(rows["event_id"], rows["event_type"], rows["ts_us"], strict=True):
            out.append((key[0], e, kind, t, high))
            high = t if high is None else max(high, t)
        return pd.DataFrame(out, columns=self.columns).astype({"event_type": object, "high_us": "Int64"}), {"high": high}

    def closed(self, key, state):
        return pd.DataFrame([(key[0], None, None, None, state["high"])], columns=self.columns).astype({"event_type": object, "event_id": "Int64", "ts_us": "Int64"})


class QuietSessionProcessor(OrderedProcessor):
    """Scores of sessions that closed without ever leaving LOW: one row for each head and score, with how often it came.

    ``at`` is the watermark at which a row comes out, as the next operator needs it; ``closed_ms`` is when the session closed.
    """

    order = ("window_id",)
    columns = ["head_id", "bin", "score", "n", "closed_ms", "at"]

    def __init__(self, heads: tuple[str, ...], idle_ms: int, bins: int = 20):
        self.heads, self.idle_ms, self.bins = heads, idle_ms, bins

    def _scores(self, state: dict) -> list[tuple]:
        if not state["quiet"]:
            return []
        at, closed = pd.Timestamp(self.now_ms, unit="ms"), state["last"] + self.idle_ms
        return [(h, min(int(p * self.bins), self.bins - 1), p, n, closed, at) for h, counts in state["scores"].items() for p, n in ((float(p), n) for p, n in counts.items())]

    def take(self, key, rows, state):
        out = []
        for k, (t, level) in enumerate(zip(rows["at_ms"], rows["state"], strict=True)):
            if state and t - state["last"] >= self.idle_ms:
                out += self._scores(state)
                state = {}
            state = state or {"quiet": True, "scores": {h: {} for h in self.heads}}
            state["last"], state["quiet"] = t, state["quiet"] and level in ("LOW", "ABSTAIN")
            for h in self.heads:
                p = rows[f"p_{h}"][k]
                if p is not None and p == p:
                    p = str(round(min(max(p, 0.0), 1.0), 6))
                    state["scores"][h][p] = state["scores"][h].get(p, 0) + 1
        return pd.DataFrame(out, columns=self.columns) if out else None, state

    def closed(self, key, state):
        out = self._scores(state)
        return pd.DataFrame(out, columns=self.columns) if out else None


class HistogramProcessor(StatefulProcessor):
    """Score counts of a head's bin, before and after ``reference_ms``, handed on at the end of each period of event time.

    The state maps (end of the period, score) to the two counts; counts of periods, bins and heads can be added up.
    """

    columns = ["head_id", "bin", "as_of_ms", "score", "n_ref", "n_current"]

    def __init__(self, reference_ms: int, period_ms: int):
        self.reference_ms, self.period_ms = reference_ms, period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "as_of_ms long, score double", "n_ref long, n_current long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[tuple[int, float], list[int]] = {}
        for pdf in rows:
            for score, n, closed in zip(pdf["score"].tolist(), pdf["n"].tolist(), pdf["closed_ms"].tolist(), strict=True):
                cell = fresh.setdefault(((closed // self.period_ms + 1) * self.period_ms, score), [0, 0])
                cell[closed >= self.reference_ms] += n
        for cell, (ref, cur) in fresh.items():
            old = self.counts.getValue(cell) if self.counts.containsKey(cell) else (0, 0)
            self.counts.updateValue(cell, (old[0] + ref, old[1] + cur))
        for as_of in {a for a, _ in fresh}:
            self.handle.registerTimer(as_of)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        done = [(cell, n) for cell, n in self.counts.iterator() if cell[0] <= now]
        for cell, _ in done:
            self.counts.removeKey(tuple(cell))
        if done:
            yield pd.DataFrame([(*key, *cell, *n) for cell, n in done], columns=self.columns)

    def close(self) -> None:
        pass


class AlertProcessor(OrderedProcessor):
    """An alert rule over windows in order: pending while the count is at or over the limit, firing after ``for_ms``.

    A window that is missing had no events, so it ends the run.  A row for each alert that fired, when it has ended.
    """

    columns = ["event_type", "pending_ms", "fired_ms", "ended_ms", "peak"]

    def __init__(self, limit: int, slide_ms: int, for_ms: int):
        self.limit, self.slide_ms, self.for_ms, self.idle_ms = limit, slide_ms, for_ms, slide_ms

    def _ended(self, key, run: dict) -> list[tuple]:
        return [(key[0], run["start"], run["fired"], run["end"], run["peak"])] if run and run["fired"] is not None else []

    def take(self, key, rows, state):
        run, out = state.get("run") or {}, []
        for end, n in zip(rows["end_ms"], rows["n"], strict=True):
            if run and (end - run["end"] > self.slide_ms or n < self.limit):
                out += self._ended(key, run)
                run = {}
            if n >= self.limit:
                run = run or {"start": end, "fired": None, "peak": 0}
                run["end"], run["peak"] = end, max(run["peak"], n)
                if run["fired"] is None and end - run["start"] >= self.for_ms:
                    run["fired"] = end
        return pd.DataFrame(out, columns=self.columns) if out else None, {"run": run}

    def closed(self, key, state):
        out = self._ended(key, state.get("run"))
        return pd.DataFrame(out, columns=self.columns) if out else None


class OwnerProcessor(OrderedProcessor):
    """Creates of a session id: the first one owns it for ``idle_ms``, its own repeats are known, other tenants are rejected.

    Once the id has lapsed the next create owns it anew; the state goes when the watermark has passed that time.
    """

    order = ("event_id",)

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def take(self, key, rows, state):
        out = []
        for t, e, tenant in zip(rows["at_ms"], rows["event_id"], rows["tenant_id"], strict=True):
            if not state or t - state["since"] >= self.idle_ms:
                state = {"owner": tenant, "since": t}
                out.append((e, "created"))
            else:
                out.append((e, "repeat" if tenant == state["owner"] else "rejected"))
        return pd.DataFrame(out, columns=["event_id", "outcome"]), state


class CallViewProcessor(OrderedProcessor):
    """Fold of a call's events: the latest payload and the number of each event type, and the last sequence number."""

    order = ("seq",)
    columns = ["session_id", "risk", "context", "decision", "n_decisions", "n_windows", "last_seq"]

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def take(self, key, rows, state):
        seen, last = state.get("seen", {}), state.get("last_seq")
        for kind, payload, seq in zip(rows["event_type"], rows["payload"], rows["seq"], strict=True):
            top, newest, n = seen.get(kind, (None, None, 0))
            seen[kind] = (seq, payload, n + 1) if top is None or seq > top else (top, newest, n + 1)
            last = seq if last is None else max(last, seq)
        return None, {"seen": seen, "last_seq": last}

    def closed(self, key, state):
        latest = {k: v[1] for k, v in state["seen"].items()}
        count = {k: v[2] for k, v in state["seen"].items()}
        row = (key[0], latest.get("session_risk"), latest.get("context_signals"), latest.get("policy_decision"), count.get("policy_decision", 0), count.get("window_score", 0), state["last_seq"])
        out = pd.DataFrame([row], columns=self.columns)
        return out.astype(dict.fromkeys(("risk", "context", "decision"), "Int64"))
