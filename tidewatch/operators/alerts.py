"""Hits to alerts to cases, with the links between them, and the marts for investigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import hash_id, ratio
from ..sources.tables import transaction_id
from .intervals import within

THRESHOLD = 0.653366


def sessions(df: DataFrame, keys: list[str], at: str, days: int | Column, tie: str) -> DataFrame:
    """Adds ``session``: a new one begins where the gap to the row before is strictly over ``days`` days."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))
    new = F.when(F.lag(at).over(w).isNull() | (gap > (days if isinstance(days, Column) else F.lit(days)) * F.lit(86_400_000_000)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def ml_alert_links(tx: DataFrame, days: int = 7, threshold: float = THRESHOLD) -> DataFrame:
    """Each flagged transaction with the alert it belongs to."""
    hit = tx.where(F.col("ml_probability") >= threshold)
    hit = sessions(hit, ["Sender_account"], "ts", days, "tx_id")
    return hit.select(
        hash_id("ALT-ML1A-", F.lit("MLV1"), F.lit("AGG"), F.col("Sender_account"), F.col("session")).alias("alert_id"), transaction_id(F.col("tx_id")).alias("transaction_id"), "tx_id",
        F.col("Sender_account").alias("primary_account_id"), "ts", "Amount", "ml_probability", F.lit("TRIGGER").alias("contribution_role"),
    )


def ml_alerts(links: DataFrame, days: int = 7, threshold: float = THRESHOLD) -> DataFrame:
    out = links.groupBy("alert_id").agg(
        F.first("primary_account_id").alias("primary_account_id"), F.min("ts").alias("alert_created_at"), F.max("ts").alias("last_trigger_at"), F.countDistinct("transaction_id").alias("transaction_count"),
        F.sum("Amount").alias("alert_amount"), F.max("ml_probability").alias("ml_probability_max"), F.avg("ml_probability").alias("ml_probability_mean"),
    )
    # the texts and constants are fixed values
    reason = F.format_string("Frozen ML V1; %d triggering transaction(s); max probability=%.4f; %dd inactivity-session aggregation", F.col("transaction_count"), F.col("ml_probability_max"), F.lit(days))
    return out.withColumns({
        "detection_engine": F.lit("ML_V1"), "model_version": F.lit("ML_DETECTION_V1"), "threshold": F.lit(threshold), "aggregation_window_days": F.lit(days), "alert_status": F.lit("NEW"), "priority": F.lit("UNASSIGNED"), "trigger_reason": reason,
    })


def case_links(alerts: DataFrame, days: int = 30, prefix: str = "CAS-ML1-") -> DataFrame:
    """Each alert with its case: sessions of alert start times per account."""
    s = sessions(alerts, ["primary_account_id"], "alert_created_at", days, "alert_id")
    return s.withColumn("case_id", hash_id(prefix, F.lit("MLV1"), F.lit("CASE"), F.col("primary_account_id"), F.col("session"))).drop("session")


def case_alert_table(linked: DataFrame, days: int = 30) -> DataFrame:
    """(case_id, alert_id, link_reason, linked_at, linked_by)."""
    return linked.select("case_id", "alert_id", F.lit(f"SAME_ACCOUNT_{days}D_SESSION").alias("link_reason"), F.col("alert_created_at").alias("linked_at"), F.lit("SYSTEM").alias("linked_by"))


def ml_cases(linked: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per case with its queue rank (score, alerts, last alert, id)."""
    tx = evidence.join(linked.select("alert_id", "case_id"), "alert_id").groupBy("case_id").agg(F.countDistinct("transaction_id").alias("transaction_count"))
    out = linked.groupBy("case_id").agg(
        F.first("primary_account_id").alias("subject_id"), F.min("alert_created_at").alias("case_created_at"), F.max("last_trigger_at").alias("last_alert_at"), F.countDistinct("alert_id").alias("alert_count"),
        F.sum("alert_amount").alias("total_alert_amount"), F.max("ml_probability_max").alias("ml_probability_max"), F.avg("ml_probability_mean").alias("ml_probability_mean"),
    )
    out = out.join(tx, "case_id", "left").withColumn("transaction_count", F.coalesce("transaction_count", F.lit(0)))
    # the texts and constants are fixed values
    out = out.withColumns({
        "case_status": F.lit("OPEN"), "detection_engine": F.lit("ML_V1"), "case_priority": F.lit("UNASSIGNED"),
        "case_summary": F.format_string("%d ML alert(s); %d unique transaction(s); maximum probability %.4f", "alert_count", "transaction_count", "ml_probability_max"),
        "priority_reason": F.lit("Ranked by maximum frozen ML probability; operational ranking, not a calibrated case risk score"),
    })
    return ranked(out, [F.desc("ml_probability_max"), F.desc("alert_count"), F.desc("last_alert_at"), F.asc("case_id")], -F.floor(F.col("ml_probability_max") * 100_000))


def ranked(df: DataFrame, order: list[Column], band: Column, name: str = "queue_rank") -> DataFrame:
    """Position in a total order without one task for all rows.

    ``band`` rises along the order (a day, a rounded score) and has few values: ranks are counted within each band, after
    the sizes of the bands before it.
    """
    x = df.withColumn("_band", F.coalesce(band.cast("long"), F.lit(2**62)))
    sizes = x.groupBy("_band").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)  # one row a band
    sizes = sizes.select("_band", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_band").orderBy(*order))
    return x.join(F.broadcast(sizes), "_band").withColumn(name, place).select(*df.columns, name)


def rule_alert_links(hits: DataFrame, gaps: dict[str, int], default: int = 7) -> DataFrame:
    """Each hit (scenario_id, account, ts, tx_id, Amount) with its alert: sessions per account and scenario, each with its own gap."""
    days = F.lit(default)
    for name, d in gaps.items():
        days = F.when(F.col("scenario_id") == name, d).otherwise(days)
    s = sessions(hits, ["scenario_id", "account"], "ts", days, "tx_id")
    return s.withColumn("alert_id", hash_id("ALT-RV3-", F.col("scenario_id"), F.col("account"), F.col("session"))).drop("session")


def rule_alerts(links: DataFrame) -> DataFrame:
    """Alerts of ``rule_alert_links``."""
    return links.groupBy("alert_id", "scenario_id", F.col("account").alias("primary_account_id")).agg(F.min("ts").alias("alert_created_at"), F.max("ts").alias("last_trigger_at"), F.countDistinct("tx_id").alias("transaction_count"), F.sum("Amount").alias("alert_amount"))


def rule_queue(linked: DataFrame, weights: dict[str, int], sanctioned: str = "SCN_SANCTIONED_GEOGRAPHY") -> DataFrame:
    """Risk, priority and policy flag of each rule case (our own definition)."""
    weight = F.lit(0)
    for name, w in weights.items():
        weight = F.when(F.col("scenario_id") == name, w).otherwise(weight)
    out = linked.groupBy("case_id").agg(
        F.first("primary_account_id").alias("subject_id"), F.countDistinct("alert_id").alias("alert_count"), F.countDistinct("scenario_id").alias("scenario_count"), F.sum("transaction_count").alias("transaction_count"),
        F.max((F.col("scenario_id") == sanctioned).cast("int")).alias("policy_flag"), F.max(weight).alias("_w"), F.min("alert_created_at").alias("case_created_at"), F.max("alert_created_at").alias("last_alert_at"),
        F.concat_ws(" | ", F.array_sort(F.collect_set("scenario_id"))).alias("scenarios"),
    )
    risk = F.least(F.lit(100), F.col("_w") + 10 * (F.col("scenario_count") - 1) + 5 * F.least(F.lit(4), F.col("alert_count") - 1))
    out = out.withColumn("risk_score", risk.cast("int")).drop("_w")
    out = out.withColumn("queue_priority", F.when(F.col("risk_score") >= 80, "HIGH").when(F.col("risk_score") >= 60, "MEDIUM").otherwise("LOW"))
    return ranked(out, [F.desc("risk_score"), F.desc("last_alert_at"), F.asc("case_id")], -(F.col("risk_score").cast("long") * 1_000_000 + F.unix_date(F.to_date("last_alert_at"))))


def rule_case_links(alerts: DataFrame, days: int = 30) -> DataFrame:
    """Rule alerts with their case: sessions of alert starts per account, over all scenarios."""
    s = sessions(alerts, ["primary_account_id"], "alert_created_at", days, "alert_id")
    return s.withColumn("case_id", hash_id("CAS-RV3-", F.col("primary_account_id"), F.col("session"))).drop("session")


def transaction_alerts(df: DataFrame, scenario: str, flag: str, focal: str = "Sender_account", hours: int | None = None) -> DataFrame:
    """One alert per flagged row, numbered by time; ``hours`` gives the start of the window that the flag looked back on."""
    hit = df.where(F.col(flag) == 1)
    hit = ranked(hit, [F.asc("ts"), F.asc("tx_id")], F.floor(F.unix_seconds("ts") / 3600), "_no")
    start = F.col("ts") - F.make_dt_interval(hours=F.lit(hours)) if hours else F.lit(None).cast("timestamp")
    return hit.select(
        F.format_string(f"{scenario}-%07d", "_no").alias("alert_id"), F.lit(scenario).alias("scenario_id"), F.col(focal).alias("focal_account"), "tx_id", F.col("ts").alias("alert_timestamp"),
        start.alias("lookback_start"), F.col("Amount").alias("amount"), "Is_laundering",
    )


def alert_records(df: DataFrame, scenario: str, name: str, flag: str, score: int, focal: str = "Sender_account", hours: int | None = None, columns: tuple[str, str, str] | None = None) -> DataFrame:
    """Twelve columns for each flagged row. A window scenario gives its ``hours`` and the ``columns`` of its count, amount and counterparties;
    a transaction scenario stands for itself, with the row's own reasons."""
    hit = ranked(df.where(F.col(flag) == 1), [F.asc("ts"), F.asc("tx_id")], F.floor(F.unix_seconds("ts") / 3600), "_no")
    n, amount, others = (F.col(c) for c in columns) if columns else (F.lit(1), F.col("Amount"), F.lit(1))
    start = F.col("ts") - F.make_dt_interval(hours=F.lit(hours)) if hours else F.lit(None).cast("timestamp")
    return hit.select(
        F.format_string(f"{scenario}-%07d", "_no").alias("alert_id"), F.lit(scenario).alias("scenario_id"), F.lit(name).alias("scenario_name"), F.col(focal).cast("string").alias("focal_account"), F.col("ts").alias("alert_timestamp"),
        start.alias("lookback_start"), F.col("ts").alias("lookback_end"), n.cast("long").alias("transaction_count"), amount.alias("aggregate_amount"), others.cast("long").alias("unique_counterparties"), F.lit(score).alias("scenario_score"),
        (F.lit(name) if columns else F.col("Alert_reasons")).alias("reason"),
    )


def case_mart(cases: DataFrame, tx: DataFrame, evidence: DataFrame, hours: int = 72) -> DataFrame:
    """Each case's subject's transactions around it, with the scenarios that hit them, their countries and the subject's role.

    ``tx`` has the semantics and Sender_iso2, Receiver_iso2; ``evidence`` is (case_id, scenario_id, tx_id). Cash has neither two
    countries nor two currencies.
    """
    held = evidence.groupBy("case_id", "tx_id").agg(F.concat_ws(" | ", F.array_sort(F.collect_set("scenario_id"))).alias("_held"))
    m = case_context(cases, tx, hours).join(held, ["case_id", "tx_id"], "left")
    unlike = lambda a, b, ok: ((F.col(ok) == 1) & F.coalesce(F.col(a) != F.col(b), F.lit(True))).cast("int")
    role = F.when(F.col("Sender_account") == F.col("Receiver_account"), "BOTH").when(F.col("Sender_account") == F.col("subject_id"), "SENDER").otherwise("RECEIVER")
    return m.withColumns({
        "transaction_id": transaction_id(F.col("tx_id")), "scenario": F.coalesce("_held", F.lit("CONTEXT")), "is_alerted_transaction": F.col("_held").isNotNull().cast("int"), "sender_iso2": F.col("Sender_iso2"), "receiver_iso2": F.col("Receiver_iso2"),
        "cross_border": unlike("Sender_iso2", "Receiver_iso2", "geo_pair_applicable"), "currency_mismatch": unlike("Payment_currency", "Received_currency", "currency_pair_applicable"), "subject_role": role,
    }).drop("_held")


def investigation_queue(flagged: DataFrame, tokens: dict[str, str]) -> DataFrame:
    """One alert for each row that any of the flags hits; ``tokens`` names the flags in the ;-list (priorities are our own)."""
    score = F.col("Scenario_score").cast("int")
    hit = F.greatest(*(F.col(k) for k in tokens.values())) == 1
    return flagged.where(hit).select(
        F.format_string("INV-%010d", "tx_id").alias("Alert_id"), F.col("ts").alias("Transaction_timestamp"), "Sender_account", "Receiver_account", "Amount", F.concat_ws(";", *(F.when(F.col(k) == 1, F.lit(t)) for t, k in tokens.items())).alias("Triggered_scenarios"),
        score.alias("Priority_score"), F.when(score >= 80, "HIGH").when(score >= 60, "MEDIUM").otherwise("LOW").alias("Priority"), F.col("Alert_reasons").alias("Alert_reason"),
    )


def filtered_alerts(alerts: DataFrame, priorities: tuple[str, ...] = ("HIGH", "MEDIUM", "LOW"), scenarios: tuple[str, ...] = (), account: str = "", least_score: int = 0) -> DataFrame:
    """Alerts of these priorities with the least score, any of the scenarios in their list, and the text in either account's number, whatever its case."""
    out = alerts.where(F.col("Priority").isin(*priorities) & (F.col("Priority_score") >= least_score))
    if scenarios:
        out = out.where(F.arrays_overlap(F.split(F.coalesce("Triggered_scenarios", F.lit("")), ";"), F.array(*map(F.lit, scenarios))))
    if account.strip():
        holds = lambda c: F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lower(F.lit(account.strip())))
        out = out.where(holds("Sender_account") | holds("Receiver_account"))
    return out


def alert_overview(alerts: DataFrame, tokens: list[str]) -> DataFrame:
    """(part, name, value): alerts of each priority and of each scenario, zeros among them, and the mean score; one pass."""
    listed = F.split(F.coalesce("Triggered_scenarios", F.lit("")), ";")
    count = lambda c: F.count(F.when(c, 1)).cast("double")
    parts = {("priority", p): count(F.col("Priority") == p) for p in ("HIGH", "MEDIUM", "LOW")} | {("scenario", t): count(F.array_contains(listed, t)) for t in tokens} | {("mean", "Priority_score"): F.round(F.avg("Priority_score"), 6)}
    one = alerts.agg(*(v.alias(f"v{i}") for i, v in enumerate(parts.values())))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("part"), F.lit(b).alias("name"), F.col(f"v{i}").alias("value")) for i, (a, b) in enumerate(parts)))).alias("x")).select("x.*")


def scenario_rollup(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("alerts"), F.sum("transaction_count").alias("triggering_transactions"), F.countDistinct("primary_account_id").alias("accounts"))


def routes(mart: DataFrame) -> DataFrame:
    """Cross-border routes of each case: rows and amount."""
    route = F.concat_ws(" → ", "Sender_bank_location", "Receiver_bank_location")
    return mart.where("Cross_border = 1").groupBy("case_id", route.alias("route")).agg(F.count(F.lit(1)).alias("n"), F.sum("Amount").alias("amount"))


def timeline(linked: DataFrame) -> DataFrame:
    """Alerts per case, day and scenario."""
    return linked.groupBy("case_id", F.to_date("alert_created_at").alias("day"), "scenario_id").agg(F.count(F.lit(1)).alias("alerts"))


def queue_view(queue: DataFrame, priorities: tuple[str, ...] = ("HIGH", "MEDIUM", "LOW"), policy: bool | None = None, several: bool | None = None, n: int = 50) -> DataFrame:
    """The first ``n`` cases of the queue after its filters."""
    out = queue.where(F.col("queue_priority").isin(*priorities))
    if policy is not None:
        out = out.where(F.col("policy_flag") == int(policy))
    if several is not None:
        out = out.where((F.col("scenario_count") > 1) == several)
    return out.orderBy("queue_rank").limit(n)


def priority_counts(queue: DataFrame) -> DataFrame:
    """Cases per priority, each of the three listed."""
    each = F.explode(F.array(*(F.lit(p) for p in ("HIGH", "MEDIUM", "LOW")))).alias("queue_priority")
    names = queue.sparkSession.range(1).select(each)
    return names.join(queue.groupBy("queue_priority").count(), "queue_priority", "left").select("queue_priority", F.coalesce("count", F.lit(0)).alias("n"))


def case_context(cases: DataFrame, tx: DataFrame, hours: int = 72) -> DataFrame:
    """Transactions of each case's subject, on either side, from ``hours`` before its start to ``hours`` after its last alert, once each."""
    sides = tx.withColumn("subject_id", F.explode(F.array_distinct(F.array("Sender_account", "Receiver_account"))))
    margin = F.make_dt_interval(hours=F.lit(hours))
    c = cases.select("case_id", "subject_id", (F.col("case_created_at") - margin).alias("_from"), (F.col("last_alert_at") + margin).alias("_to"))
    return within(sides, c, "subject_id", "ts", "_from", "_to").drop("_from", "_to")


def network_complexity(mart: DataFrame) -> DataFrame:
    other = F.when(F.col("Sender_account") == F.col("subject_id"), F.col("Receiver_account")).otherwise(F.col("Sender_account"))
    return mart.groupBy("case_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.when(F.col("network_eligible") == 1, other)).alias("unique_counterparties"), F.sum("Cross_border").alias("cross_border"), F.sum("is_alerted").alias("alerted"))


def edges(mart: DataFrame) -> DataFrame:
    e = mart.where("network_eligible = 1").groupBy("case_id", F.col("Sender_account").alias("src"), F.col("Receiver_account").alias("dst"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum("Amount").alias("amount"))


def country_totals(tx: DataFrame) -> DataFrame:
    side = lambda s, n: tx.where(F.col(f"{s}_bank_location").isNotNull()).groupBy(F.col(f"{s}_bank_location").alias("country")).agg(F.sum("Amount").alias(n), F.count(F.lit(1)).alias(f"{n}_count"))
    out = side("Sender", "sent").join(side("Receiver", "received"), "country", "full_outer")
    return out.select("country", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sent", "sent_count", "received", "received_count")))


def manifest(tx: DataFrame, alerts: DataFrame, links: DataFrame) -> DataFrame:
    a = alerts.agg(F.count(F.lit(1)).alias("alerts"), F.countDistinct("primary_account_id").alias("accounts"))
    b = links.agg(F.countDistinct("transaction_id").alias("evidence_transactions"), F.count(F.lit(1)).alias("flagged"))
    return a.crossJoin(b).select("alerts", "accounts", "evidence_transactions", "flagged", F.round(1 - ratio(F.col("alerts"), F.col("flagged")), 6).alias("reduction_pct"))


def violations(alerts: DataFrame, links: DataFrame, cases: DataFrame, linked: DataFrame) -> DataFrame:
    """(check, n_bad): duplicate ids, orphans on either side, alerts in no case or in several, no alerts at all.

    One union of ids with their roles is grouped once for alerts and once for cases.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    role = lambda df, key, name: df.select(F.col(key).alias("id"), *((one if n == name else none).alias(n) for n in ("head", "link", "cased")))
    a = role(alerts, "alert_id", "head").unionByName(role(links, "alert_id", "link")).unionByName(role(linked.select("alert_id", "case_id").distinct(), "alert_id", "cased"))
    a = a.groupBy("id").agg(*(F.sum(n).alias(n) for n in ("head", "link", "cased")))
    c = role(cases, "case_id", "head").unionByName(role(linked, "case_id", "link")).groupBy("id").agg(F.sum("head").alias("head"), F.sum("link").alias("link"))
    bad = lambda cond, n="1": F.coalesce(F.sum(F.when(F.expr(cond), F.expr(n))), F.lit(0)).cast("long")
    of_alerts = {
        "duplicate_alert_ids": bad("head > 1"), "orphan_alert_links": bad("head = 0", "link"), "alerts_without_evidence": bad("link = 0", "head"), "alerts_in_several_cases": bad("cased > 1"),
        "alerts_without_case": bad("cased = 0", "head"), "no_alerts": (F.coalesce(F.sum("head"), F.lit(0)) == 0).cast("long"),
    }
    of_cases = {"duplicate_case_ids": bad("head > 1"), "orphan_case_links": bad("head = 0", "link")}
    table = lambda df, checks: df.agg(*(v.alias(k) for k, v in checks.items())).unpivot([], list(checks), "check", "n_bad")
    return table(a, of_alerts).unionByName(table(c, of_cases))


def case_alerts(linked: DataFrame, cases: DataFrame) -> DataFrame:
    """The alerts of the given cases."""
    return linked.join(cases.select("case_id").distinct(), "case_id", "left_semi")
