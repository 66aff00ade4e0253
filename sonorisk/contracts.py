"""Message contracts: the rules a row must meet, and the split into valid rows and quarantine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

Rule = tuple[str, Callable[[], Column]]  # reason, condition that breaks the contract
c = F.col
# fixed values: enumerations and ranges of the message contracts
HEAD_IDS = ("A", "B", "C", "D", "E", "F")
STATES = ("LOW", "ELEVATED", "HIGH", "ABSTAIN")
CONTRACTS: dict[str, list[Rule]] = {
    "head_score": [
        ("head_id", lambda: ~c("head_id").isin(*HEAD_IDS)),
        ("window_id", lambda: c("window_id") < 0),
        ("p_spoof range", lambda: ~c("p_spoof").between(0, 1)),
        ("p_spoof required", lambda: ~c("abstain") & c("p_spoof").isNull()),
        ("confidence range", lambda: ~c("confidence").between(0, 1)),
        ("latency_ms", lambda: c("latency_ms") < 0),
    ],
    "analysis_window": [
        ("window_id", lambda: c("window_id") < 0),
        ("end after start", lambda: c("end_ms") <= c("start_ms")),
        ("clipping_ratio range", lambda: ~c("clipping_ratio").between(0, 1)),
        ("voiced_ms", lambda: c("voiced_ms") < 0),
    ],
    "fused_window": [("p_spoof range", lambda: ~c("p_spoof").between(0, 1)), ("state", lambda: ~c("state").isin(*STATES))],
    "session_risk": [
        ("risk_score range", lambda: ~c("risk_score").between(0, 100)),
        ("state", lambda: ~c("state").isin(*STATES)),
        ("abstain_ratio range", lambda: ~c("abstain_ratio").between(0, 1)),
        ("max under mean", lambda: c("p_spoof_session_max") < c("p_spoof_session_mean")),
    ],
}


def broken_rules(contract: str, required: tuple[str, ...] = ()) -> Column:
    rules = [F.when(c(f).isNull(), F.lit(f"missing {f}")) for f in required]
    rules += [F.when(cond(), F.lit(name)) for name, cond in CONTRACTS[contract]]
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def validate(df: DataFrame, contract: str, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine with reasons); no row is lost."""
    t = df.withColumn("reasons", broken_rules(contract, required))
    return t.filter(F.size("reasons") == 0).drop("reasons"), t.filter(F.size("reasons") > 0)
