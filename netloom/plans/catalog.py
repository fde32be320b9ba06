"""Named queries over the test tables, one per operator or group of operators.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` that reads whole tables. Doubles are rounded
so that the order in which a sum was taken does not show.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import net, times, values
from netloom.operators import alerts as al
from netloom.operators import analytics as an
from netloom.operators import blocking, dedup, features, flows, incidents, intel, labels, ranking, rules, training
from netloom.plans import detect, views
from netloom.session import run_dir, stage, tune
from netloom.sources import jsonl

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark, sf_dir):
        tune(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def rounded_waits(df: DataFrame) -> DataFrame:
    """As :func:`rounded`; a nudge keeps means of whole microseconds off the rounding edge."""
    return df.select(*[F.round(F.col(c) + F.lit(3e-9), 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


# ---------------------------------------------------------------- shared stages

def _flows(spark, sf) -> DataFrame:
    return flows.aggregate_flows(views.packets(spark, sf), views.GAP_SECONDS, views.HOME_NETS)


def _scored(spark, sf) -> DataFrame:
    return views.score_by_id(_flows(spark, sf))


def _alerts(spark, sf) -> DataFrame:
    return detect.detect_alerts(_scored(spark, sf), views.config())


def _stored_alerts(spark, sf) -> DataFrame:
    """Alerts as a written table, for plans that start from them more than once."""
    return stage(_alerts(spark, sf), "alerts")


def _fired(spark, sf) -> DataFrame:
    return dedup.deduplicate(_stored_alerts(spark, sf), views.DEDUP_SECONDS)


def _enriched(spark, sf) -> DataFrame:
    return intel.enrich(_fired(spark, sf), views.blocklist(spark, sf), views.geo_table(spark, sf))


def _end(spark, sf) -> Column:
    return views.table(spark, sf, "events").agg(F.max("ts")).scalar()


# ---------------------------------------------------------------- packets and flows

@query
def packets_decode(spark, sf):
    """Flag bits of a raw flag byte, IPv4 rows only, ports only for TCP and UDP."""
    from netloom.sources.packets import decode_packets

    e = views.table(spark, sf, "events")
    k = F.from_json("props", "k bigint")["k"]
    raw = e.select(
        F.col("event_id").alias("packet_id"), "ts", F.when(k % 10 == 0, 6).otherwise(4).alias("ip_version"),
        F.lit("10.0.0.1").alias("src_ip"), F.lit("10.0.0.2").alias("dst_ip"),
        (F.lit(50000) + F.col("user_id")).cast("int").alias("src_port"), F.lit(80).alias("dst_port"),
        F.when(k % 3 == 0, 17).when(k % 3 == 1, 6).otherwise(1).alias("protocol"),
        (k + 40).cast("int").alias("ip_len"), F.lit(64).alias("ttl"), (k % 64).cast("int").alias("flags"))
    return decode_packets(raw).select("packet_id", "src_port", "dst_port", "protocol", "fin", "syn", "rst", "psh", "ack", "urg")


@query
def flows_all(spark, sf):
    return rounded_waits(_flows(spark, sf))


@query
def flows_untied(spark, sf):
    """Same flows without the step that merges equal timestamps (one shuffle less)."""
    return rounded_waits(flows.aggregate_flows(views.packets(spark, sf), views.GAP_SECONDS, views.HOME_NETS, combine_ties=False))


@query
def flows_syn_sender(spark, sf):
    """Source is the sender of the first opening packet."""
    f = flows.aggregate_flows(views.packets(spark, sf), views.GAP_SECONDS, views.HOME_NETS, orient="syn_sender")
    return rounded_waits(f.select("flow_id", "_src_ip", "_src_port", "_dst_ip", "_dst_port", "src_bytes", "dst_bytes", "direction"))


@query
def flows_loopback(spark, sf):
    """The same traffic between equal addresses, where the order of packets decides their direction."""
    p = views.packets(spark, sf).withColumns({"src_ip": F.lit("127.0.0.1"), "dst_ip": F.lit("127.0.0.1")})
    return rounded_waits(flows.aggregate_flows(p, views.GAP_SECONDS, views.HOME_NETS))


@query
def flows_multi_sensor(spark, sf):
    """Two sensors, the second sees only some event types; what both see counts twice."""
    p = views.packets(spark, sf)
    second = p.where((F.col("syn") == 1) | (F.col("rst") == 1)).withColumn("sensor_id", F.lit("s2"))
    f = flows.aggregate_flows(flows.merge_sensors(p, second), views.GAP_SECONDS, views.HOME_NETS)
    return rounded_waits(f.select("flow_id", "packet_count", "src_bytes", "dst_bytes", "fwd_packet_count", "bwd_packet_count",
                            "syn_flag_count", "rst_flag_count", "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min"))


@query
def flow_direction(spark, sf):
    return _flows(spark, sf).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query
def features_clean(spark, sf):
    """Model input of flows with infinities, NaN, huge rates and gaps put in."""
    f = _flows(spark, sf)
    i = F.col("flow_id") % 9
    dirty = f.withColumns({
        "flow_bytes_per_sec": F.when(i == 0, F.lit(float("inf"))).when(i == 1, F.lit(1e12)).otherwise(F.col("flow_bytes_per_sec")),
        "flow_packets_per_sec": F.when(i == 2, F.lit(float("-inf"))).otherwise(F.col("flow_packets_per_sec")),
        "avg_packet_len": F.when(i == 3, F.lit(float("nan"))).when(i == 4, F.lit(None)).otherwise(F.col("avg_packet_len")),
    }).drop("rst_flag_count")
    return rounded_waits(features.model_features(dirty, keep=("flow_id",)).drop("_timestamp"))


# ---------------------------------------------------------------- rules

@query
def rules_first(spark, sf):
    f = _flows(spark, sf)
    return f.select("flow_id", rules.first_match(f, views.rule_set()).alias("signature_match"))


@query
def rules_all(spark, sf):
    f = _flows(spark, sf)
    return f.select("flow_id", F.concat_ws(" + ", rules.all_matches(f, views.rule_set())).alias("matches"))


@query
def rules_meta(spark, sf):
    m = rules.explode_matches(_flows(spark, sf), views.rule_set())
    return m.select("flow_id", "rule_id", "name", "severity", F.concat_ws(",", "tags").alias("tags"), "description")


@query
def rules_as_data(spark, sf):
    f = _flows(spark, sf)
    return rules.match_rule_table(f, rules.rules_frame(spark, views.rule_set())).select("flow_id", "rule_id")


@query
def rules_as_data_mixed(spark, sf):
    """Texts as the value of a membership test, lists of mixed types, booleans, large doubles as text."""
    f = _flows(spark, sf)
    return rules.match_rule_table(f, rules.rules_frame(spark, views.mixed_rules())).select("flow_id", "rule_id")


@query
def rules_default(spark, sf):
    """The shipped rules on the same flows."""
    m = rules.explode_matches(_flows(spark, sf), rules.default_rules())
    return m.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def rules_toggled(spark, sf):
    """Hits per rule after one rule was switched off and another on."""
    changed = rules.set_enabled(rules.set_enabled(views.rule_set(), "V_PORT", False), "V_OFF", True)
    return rules.explode_matches(_flows(spark, sf), changed).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query
def rule_tag_hits(spark, sf):
    """Hits of the enabled rules by tag."""
    m = rules.explode_matches(_flows(spark, sf), views.rule_set())
    return m.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query
def rule_catalogue_hits(spark, sf):
    """Every catalogue rule with its self-test result, condition count and hits on the flows."""
    from netloom.sources.rulefile import rules_table

    table = rules.filter_rules(rules_table(spark), enabled_only=True)
    hits = rules.explode_matches(_flows(spark, sf), rules.default_rules()).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    probe = rules.self_test(spark, rules.default_rules())
    info = rules.rules_summary(table).select(F.col("id").alias("rule_id"), "severity", "conditions")
    return info.join(probe, "rule_id").join(hits, "rule_id", "left").select("rule_id", "severity", "conditions", "fired", F.coalesce("n", F.lit(0)).cast("long").alias("hits"))


# ---------------------------------------------------------------- scores and alerts

@query
def severity(spark, sf):
    return _scored(spark, sf).groupBy(F.coalesce(al.severity_of(F.col("score")), F.lit("none")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query
def score_label(spark, sf):
    return _scored(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query
def ensemble_score(spark, sf):
    """Both models, either model alone, and other weights."""
    f = _scored(spark, sf)
    rf, ae = F.col("rf_score"), F.col("ae_score")
    return rounded(f.select("flow_id", al.combine_scores(rf, ae).alias("ensemble"), al.combine_scores(rf, None).alias("rf_only"),
                            al.combine_scores(None, ae).alias("ae_only"), al.combine_scores(rf, ae, 0.9, 0.9).alias("heavy")))


@query
def alerts_raised(spark, sf):
    return rounded(_alerts(spark, sf).select("alert_id", "alert_ts", "severity", "label", "score", "signature_match", "direction", "_src_ip", "_dst_ip", "_dst_port"))


@query
def alerts_rule_severity(spark, sf):
    """Alternative in which a match keeps the severity of its first rule."""
    f = _scored(spark, sf)
    own = rules.match_metadata(f, views.rule_set())[0]["severity"]
    a = al.raise_alerts(f, rules.first_match(f, views.rule_set()), rule_severity=own)
    return a.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query
def alerts_dedup(spark, sf):
    return _fired(spark, sf).select("alert_id", "alert_ts", "suppressed_since_last", "suppression_note")


@query
def alerts_dedup_blocks(spark, sf):
    """All alerts as one fingerprint in blocks of two windows, cut by rows and composed over several levels."""
    a = _stored_alerts(spark, sf).withColumns({"_src_ip": F.lit("any"), "_dst_ip": F.lit("any"), "_dst_port": F.lit(0)})
    return dedup.fired_ids(a, 7200.0, 2, block_rows=64, group_rows=256).select("alert_id", "suppressed")


@query
def alert_incident_map(spark, sf):
    a = incidents.assign_incidents(_fired(spark, sf), views.INCIDENT_SECONDS)
    return a.select("alert_id", "_src_ip", "incident_id")


@query
def incidents_all(spark, sf):
    return incidents.correlate(_enriched(spark, sf), views.INCIDENT_SECONDS, _end(spark, sf))


@query
def incidents_unfired(spark, sf):
    """Incidents over every raised alert, without enrichment."""
    i = incidents.correlate(_alerts(spark, sf), views.INCIDENT_SECONDS, _end(spark, sf))
    return i.select("incident_id", "src_ip", "start_time", "end_time", "alert_count", "max_severity", "status")


# ---------------------------------------------------------------- intel and blocking

@query
def blocklist_parse(spark, sf):
    return views.blocklist(spark, sf)


@query
def blocklist_merge(spark, sf):
    """Two feeds united: the text feed and the clients of error events."""
    errors = views.packets(spark, sf).where("rst = 1").select(F.col("src_ip").alias("ip"))
    return intel.merge_feeds(views.blocklist(spark, sf), errors)


@query
def blocklist_flag(spark, sf):
    f = intel.flag_blocklisted(_flows(spark, sf), views.blocklist(spark, sf))
    return f.select("flow_id", "_src_ip", "is_malicious", "threat_level")


@query
def geo_enrich(spark, sf):
    f = intel.locate(_flows(spark, sf), views.geo_table(spark, sf), "_dst_ip")
    return rounded(f.select("flow_id", "_dst_ip", "lat", "lon", "country", "countryCode", "city", "isp", "asn"))


@query
def intel_enrich(spark, sf):
    return _enriched(spark, sf).select("alert_id", "_src_ip", "is_malicious", "threat_level", "country", "city", "isp", "asn")


@query
def cidr_join(spark, sf):
    """Every (address, network) pair of the clients and servers seen."""
    ips = views.packets(spark, sf).select(F.col("src_ip").alias("ip"))
    return intel.network_matches(ips, views.network_table(spark, sf), "ip").select("ip", "cidr")


@query
def cidr_longest(spark, sf):
    """Flows with the longest network of their source."""
    f = intel.locate_by_network(_flows(spark, sf), views.network_table(spark, sf), "_src_ip")
    return f.select("flow_id", "_src_ip", "cidr")


@query
def cidr_direction(spark, sf):
    """Direction from a table of home networks."""
    f = intel.direction_by_networks(_flows(spark, sf), views.network_table(spark, sf))
    return f.select("flow_id", "direction")


@query
def ip_predicates(spark, sf):
    """Number, validity, block safety and lookup rule of addresses, good and bad ones."""
    k = F.col("user_id")
    ip = F.when(k % 8 == 0, F.concat(F.lit("172.16.0."), k % 256)).when(k % 8 == 1, F.concat(F.lit("10.0.0."), k)).when(
        k % 8 == 2, F.lit("127.0.0.1")).when(k % 8 == 3, F.lit("")).when(k % 8 == 4, F.lit("not an ip")).otherwise(
        F.concat((k % 223 + 1).cast("string"), F.lit("."), (k % 256).cast("string"), F.lit(".4.1")))
    e = views.table(spark, sf, "events").select("event_id", ip.alias("ip"))
    return e.select("event_id", "ip", net.ipv4_number(F.col("ip")).alias("number"), net.is_blockable(F.col("ip")).alias("blockable"),
                    net.skips_enrichment(F.col("ip")).alias("skipped"))


@query
def blocked_ips(spark, sf):
    return blocking.blocked_addresses(views.commands(spark, sf), ("ts", "packet_id"))


@query
def blocked_alerts(spark, sf):
    b = blocking.blocked_addresses(views.commands(spark, sf), ("ts", "packet_id"))
    return blocking.only_blocked(_alerts(spark, sf), b).select("alert_id", "_src_ip")


@query
def unblocked_incidents(spark, sf):
    b = blocking.blocked_addresses(views.commands(spark, sf), ("ts", "packet_id"))
    i = incidents.correlate(_alerts(spark, sf), views.INCIDENT_SECONDS, _end(spark, sf))
    return blocking.without_blocked(i, b, "src_ip").select("incident_id", "src_ip", "alert_count")


# ---------------------------------------------------------------- reports

@query
def stats_snapshot(spark, sf):
    """Totals, rates, score figures and distributions of the snapshot in long form."""
    f = stage(_scored(spark, sf), "flows")
    a = detect.detect_alerts(f, views.config())
    num = lambda kind, df: df.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("e")).select("e.*")
    dist = an.alert_distributions(a).select(F.col("dimension").alias("kind"), "item", F.col("n").cast("double").alias("value"))
    ports = an.port_distribution(f).select(F.lit("port").alias("kind"), F.col("port").cast("string").alias("item"), F.col("n").cast("double").alias("value"))
    parts = [num("total", an.totals(f, a)), num("score", an.score_summary(a)), dist, ports]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, 4)


@query
def rolling_rates(spark, sf):
    return an.rolling_rates(_scored(spark, sf), _alerts(spark, sf), _end(spark, sf), 86400.0)


@query
def kpi(spark, sf):
    return an.kpis(_scored(spark, sf), _alerts(spark, sf))


@query
def period_compare(spark, sf):
    return an.compare_periods(_scored(spark, sf), _alerts(spark, sf), _end(spark, sf), 5 * 86400.0)


@query
def period_compare_empty(spark, sf):
    """Periods in which no alert was high or medium."""
    calm = _alerts(spark, sf).where("severity = 'low'")
    return an.compare_periods(_scored(spark, sf), calm, _end(spark, sf), 5 * 86400.0)


@query
def severity_breakdown(spark, sf):
    return an.severity_breakdown(_alerts(spark, sf))


@query
def alert_timeline(spark, sf):
    return an.timeline(_alerts(spark, sf), 1800)


@query
def heatmap(spark, sf):
    return an.heatmap(_alerts(spark, sf))


@query
def score_hist(spark, sf):
    return an.score_histogram(_scored(spark, sf))


@query
def score_quantiles(spark, sf):
    return rounded(ranking.exact_quantiles(_scored(spark, sf), "score", [0.5, 0.75, 0.9, 0.95, 0.99]), 4)


@query
def price_quantiles(spark, sf):
    """Same operator on a large column with many repeated and many distinct values."""
    li = views.table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") % 3 == 0, F.lit(5000.0)).otherwise(F.col("l_extendedprice")).alias("x"))
    return rounded(ranking.exact_quantiles(li, "x", [0.0, 0.05, 0.5, 0.95, 1.0]), 4)


@query
def geo_hotspots(spark, sf):
    a = intel.locate(_alerts(spark, sf), views.geo_table(spark, sf))
    return rounded(an.geo_hotspots(a))


@query
def traffic_matrix(spark, sf):
    return an.traffic_links(_flows(spark, sf))


@query
def traffic_matrix_top(spark, sf):
    return an.top_traffic_links(_flows(spark, sf))


def _busy_links(spark, sf) -> DataFrame:
    """Flows between blocks of addresses, which the busiest sources and targets have in common."""
    block = lambda c: F.concat(F.substring_index(c, ".", 3), F.lit("."), (F.split_part(c, F.lit("."), F.lit(4)).cast("int") % 3).cast("string"))
    return _flows(spark, sf).withColumns({c: block(c) for c in ("_src_ip", "_dst_ip")})


@query
def block_matrix_top(spark, sf):
    """Links between the six busiest source blocks and target blocks."""
    return an.top_traffic_links(_busy_links(spark, sf))


@query
def block_index(spark, sf):
    return an.indexed_links(an.top_traffic_links(_busy_links(spark, sf)))


@query
def block_list(spark, sf):
    """Distinct ends of the top links between blocks, numbered."""
    return an.link_nodes(an.top_traffic_links(_busy_links(spark, sf)))


@query
def node_index(spark, sf):
    return an.indexed_links(an.top_traffic_links(_flows(spark, sf)))


@query
def node_list(spark, sf):
    """Distinct ends of the top links."""
    return an.link_nodes(an.top_traffic_links(_flows(spark, sf))).select("node")


@query
def top_ports(spark, sf):
    return ranking.top_counts(_flows(spark, sf), "dst_port", 10)


@query
def top_sources(spark, sf):
    return ranking.top_counts(_alerts(spark, sf), "_src_ip", 5)


@query
def top_destinations(spark, sf):
    return ranking.top_counts(_alerts(spark, sf), "_dst_ip", 5)


@query
def geo_candidates(spark, sf):
    """The 30 busiest sources, those worth a location lookup."""
    return ranking.top_counts(_alerts(spark, sf), "_src_ip", 30)


@query
def run_summary(spark, sf):
    return an.run_summary(_scored(spark, sf), _alerts(spark, sf))


@query
def alerts_recent(spark, sf):
    """Newest alerts, then the severity filter (in that order)."""
    return rounded(an.filter_severity(_alerts(spark, sf), ["high", "medium"], 200).select("alert_id", "alert_ts", "severity", "score"))


@query
def incidents_recent(spark, sf):
    """Newest incidents in reading form."""
    i = incidents.correlate(_enriched(spark, sf), views.INCIDENT_SECONDS, _end(spark, sf))
    newest = i.orderBy(F.col("end_time").desc(), F.col("src_ip")).limit(100)
    return incidents.incident_rows(newest)


@query
def alert_ticker(spark, sf):
    return an.alert_ticker(_alerts(spark, sf))


@query
def alert_csv_view(spark, sf):
    return an.alert_table(_fired(spark, sf)).select("alert_id", "time", "severity", "_src_ip", "_src_port", "_dst_ip", "_dst_port", "score", "label", "signature_match", "suppression_note")


@query
def alert_inspect(spark, sf):
    """Score details of the newest alert."""
    a = _alerts(spark, sf)
    newest = a.agg(F.max_by("alert_id", F.struct("alert_ts", "alert_id"))).scalar()
    return an.inspect_alert(a, newest).select("alert_id", "ensemble_score", "rf_confidence", "anomaly_score")


@query
def console_lines(spark, sf):
    return an.console_lines(_fired(spark, sf))


@query
def uptime_text(spark, sf):
    e = views.table(spark, sf, "events")
    return e.select("event_id", times.uptime_text(F.col("event_id") * 7.5).alias("uptime"), values.fingerprint(F.col("user_id"), F.nullif(F.col("event_type"), F.lit("click"))).alias("fp"))


# ---------------------------------------------------------------- logs

@query
def jsonl_import(spark, sf):
    rec = jsonl.parse_lines(views.log_lines(spark, sf), keep=("event_id",))
    return rounded(jsonl.to_flow_table(rec, keep=("event_id",)).drop("raw_json"))


@query
def jsonl_last(spark, sf):
    """The newest 500 log records with a class."""
    rec = jsonl.parse_lines(views.log_lines(spark, sf), keep=("event_id",))
    return jsonl.last_records(rec, 1, 500, tie="event_id").select("event_id", "_src_ip", "is_attack")


@query
def json_payload(spark, sf):
    """Rows to JSON and back, with the severity test on the payload."""
    from netloom.sources.tables import payload, read_payload

    a = _alerts(spark, sf).select("alert_id", "alert_ts", "severity", "score", "_src_ip")
    stored = a.select("alert_id", payload(a).alias("raw_json"))
    hit = F.get_json_object("raw_json", "$.severity").isin("high", "medium")
    back = read_payload(stored.withColumn("critical", hit), a.schema, keep=("critical",))
    return rounded(back.select("alert_id", "severity", "score", "_src_ip", "critical"))


@query
def alert_store_recent(spark, sf):
    """The newest 100 alerts of a store that they were appended to in two goes."""
    from netloom.sources import tables

    root, a = run_dir(spark, "store"), _stored_alerts(spark, sf)
    for even in (0, 1):
        tables.append_alerts(a.where(F.col("alert_id") % 2 == even), root)
    return tables.recent_rows(spark, root, "alerts", 100).select("alert_id", "alert_ts", "severity")


# ---------------------------------------------------------------- training data

@query
def capture_training(spark, sf):
    """Two captures with a label each, added to a folder of CSVs and read back as training rows."""
    from netloom.sources import tables, training_files

    folder, f = run_dir(spark, "captures"), stage(_flows(spark, sf), "flows")
    tables.append_labelled(f.where("rst_flag_count > 0"), "Reset", folder)
    tables.append_labelled(f.where("rst_flag_count = 0"), " benign", folder)
    t = training_files.load_mixed_flows(spark, folder)
    return t.groupBy("label", "is_attack").agg(F.count(F.lit(1)).alias("n"), F.sum("packet_count").cast("long").alias("packets"), F.sum("src_bytes").cast("long").alias("bytes"))


def _near_alerts(spark, sf, flows=None):
    """Alerts moved by a few seconds, some of them twice, so that the band decides; ``flows`` are the flows if they are there already."""
    a = _alerts(spark, sf) if flows is None else detect.detect_alerts(views.score_by_id(flows), views.config())
    shift = (F.col("alert_id") % 7 - 3) * 2
    moved = a.withColumn("alert_ts", F.col("alert_ts") + F.make_dt_interval(secs=shift.cast("decimal(18,6)")))
    return moved.unionByName(moved.where(F.col("alert_id") % 3 == 0))


@query
def label_join(spark, sf):
    j = labels.label_flows(stage(_flows(spark, sf), "flows"), _near_alerts(spark, sf))
    return j.select("flow_id", "label", "_dst_port")


@query
def label_join_counts(spark, sf):
    """Flows with their labels and the number of alerts behind each."""
    j = labels.label_counts(stage(_flows(spark, sf), "flows"), _near_alerts(spark, sf))
    return j.select("flow_id", "label", "times")


@query
def label_join_kinds(spark, sf):
    """Alerts of several kinds close together, some without a label, in a band of hours that holds many of them."""
    a = stage(_near_alerts(spark, sf).select("alert_id", "_src_ip", "_dst_ip", "alert_ts"), "near")
    kind = F.element_at(F.array(F.lit("SCAN"), F.lit("FLOOD"), F.lit(""), F.lit(None).cast("string")), (F.col("alert_id") % 4 + 1).cast("int"))
    f = stage(_flows(spark, sf).withColumn("_dst_port", F.lit(80)), "flows")
    a = a.withColumns({"label": kind, "_dst_port": F.lit(80)})
    counts = labels.label_counts(f, a, seconds=6 * 3600.0).select("flow_id", "label", "times")
    best = labels.label_flows(f, a, seconds=6 * 3600.0, one_label=True).select("flow_id", F.concat(F.lit("best "), "label").alias("label"), F.lit(1).cast("long").alias("times"))
    return counts.unionByName(best).groupBy("flow_id", "label").agg(F.sum("times").alias("times"))


@query
def label_join_single(spark, sf):
    j = labels.label_flows(stage(_flows(spark, sf), "flows"), _near_alerts(spark, sf), one_label=True)
    return j.select("flow_id", "label")


@query
def train_clean_strict(spark, sf):
    t = training.clean_strict(training.harmonise(views.labelled_lineitem(spark, sf), keep=("row_id",)))
    return rounded(t.groupBy("label", "is_attack").agg(F.count(F.lit(1)).alias("n"), F.sum("packet_count").alias("packets"), F.sum("flow_iat_max").alias("iat")), 3)


@query
def train_clean_lenient(spark, sf):
    t = training.clean_lenient(training.harmonise(views.labelled_lineitem(spark, sf), keep=("row_id",)))
    return rounded(t.groupBy("label", "is_attack").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("flow_bytes_per_sec") == 0).alias("zero_rates"), F.sum("dst_port").alias("ports")), 3)


@query
def train_union(spark, sf):
    """Public rows and labelled own flows together."""
    public = training.harmonise(views.labelled_lineitem(spark, sf)).withColumn("times", F.lit(1).cast("long"))
    own = labels.label_counts(stage(_flows(spark, sf), "flows"), _near_alerts(spark, sf))
    own = training.harmonise(own, keep=("times",))
    t = training.clean_strict(training.unite(public, own))
    return t.groupBy("label", "is_attack").agg(F.sum("times").alias("n"))


@query
def class_balance(spark, sf):
    return training.class_gate(training.clean_strict(training.harmonise(views.labelled_lineitem(spark, sf))))


@query
def stratified_split(spark, sf):
    t = _train_rows(spark, sf)
    return ranking.stratified_split(t, "is_attack", ["row_id"]).select("row_id", "is_attack", "is_train")


@query
def shuffled_head(spark, sf):
    t = stage(training.harmonise(views.labelled_lineitem(spark, sf), keep=("row_id",)), "train")
    return ranking.shuffled_head(t, 5000, ["row_id"]).select("row_id")


@query
def online_set(spark, sf):
    f = _scored(spark, sf).withColumn("_logged_at", F.col("flow_end"))
    a = _alerts(spark, sf).withColumn("_logged_at", F.col("alert_ts"))
    t = training.online_set(a, f, max_alerts=300, max_benign=400)
    return rounded(t.groupBy("is_attack").agg(F.count(F.lit(1)).alias("n"), F.sum("packet_count").alias("packets"), F.sum("src_bytes").alias("bytes")), 3)


@query
def confusion(spark, sf):
    t = _scored(spark, sf).select((F.col("rf_score") > 0.4).cast("int").alias("is_attack"), (F.col("score") >= 0.5).cast("int").alias("prediction"))
    return training.confusion(t)


@query
def class_report(spark, sf):
    t = _scored(spark, sf).select((F.col("rf_score") > 0.4).cast("int").alias("is_attack"), (F.col("score") >= 0.5).cast("int").alias("prediction"))
    return training.class_report(t)


# ---------------------------------------------------------------- streams
# Each takes its table in several later stretches of time, one batch after the other; what is still open at the
# last watermark stays in state.

TURNS = 5


def _turns(df: DataFrame, ts: str, *others: tuple[DataFrame, str]) -> tuple[list[DataFrame], list[Callable[[], None]]]:
    """Tables as streams that grow by ``TURNS`` later stretches of time, and what lets them grow.

    Every stretch is a batch of its own, so state and watermark are carried from one to the next.
    """
    spark, tables = df.sparkSession, [(df, ts), *others]
    paths = [run_dir(spark, "turns") for _ in tables]
    for (d, _), path in zip(tables, paths, strict=True):
        d.limit(0).write.parquet(path)
    spans = [d.agg(F.min(t).cast("timestamp"), F.max(t).cast("timestamp")).first() for d, t in tables]
    low, high = min(x[0] for x in spans), max(x[1] for x in spans)
    edges = [low + (high - low) * i / TURNS for i in range(1, TURNS)]

    def feed(turn: int) -> Callable[[], None]:
        def append() -> None:
            for (d, t), path in zip(tables, paths, strict=True):
                stamp = F.col(t).cast("timestamp")
                after = stamp >= edges[turn - 1] if turn else F.lit(True)
                d.where(after & (stamp < edges[turn] if turn < TURNS - 1 else F.lit(True))).write.mode("append").parquet(path)
        return append

    streams = [spark.readStream.schema(d.schema).parquet(path).withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, "0 seconds") for (d, t), path in zip(tables, paths, strict=True)]
    return streams, [feed(i) for i in range(TURNS)]


def _packet_turns(spark, sf) -> tuple[DataFrame, list[Callable[[], None]]]:
    (packets,), feeds = _turns(stage(views.packets(spark, sf), "packets"), "ts")
    return packets, feeds


def _alert_turns(spark, sf) -> tuple[DataFrame, list[Callable[[], None]]]:
    (alerts,), feeds = _turns(_stored_alerts(spark, sf), "alert_ts")
    return alerts, feeds


def _ntz(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query
def stream_flows(spark, sf):
    from netloom.streaming.flow_state import stream_flows as run
    from netloom.streaming.runner import drain_in_turns

    packets, feeds = _packet_turns(spark, sf)
    return rounded_waits(_ntz(drain_in_turns(run(packets, views.GAP_SECONDS, views.HOME_NETS), "stream-flows", feeds)))


@query
def stream_dedup(spark, sf):
    from netloom.streaming.dedup_state import stream_dedup as run
    from netloom.streaming.runner import drain_in_turns

    alerts, feeds = _alert_turns(spark, sf)
    fired = drain_in_turns(run(alerts.select("alert_id", "alert_ts", "_src_ip", "_dst_ip", "_dst_port", "label"), views.DEDUP_SECONDS), "stream-dedup", feeds)
    return _ntz(fired.select("alert_id", "alert_ts", "suppressed_since_last", "suppression_note"))


@query
def stream_incidents(spark, sf):
    from netloom.streaming.operators import stream_incidents as run
    from netloom.streaming.runner import drain_in_turns

    alerts, feeds = _alert_turns(spark, sf)
    out = drain_in_turns(run(alerts, views.INCIDENT_SECONDS), "stream-incidents", feeds)
    return _ntz(out.select("incident_id", "src_ip", "start_time", "end_time", "alert_count", "max_severity", "status"))


def _shuffled_stream(df: DataFrame, key: str) -> DataFrame:
    """Five files whose rows come in no order of time, one for each micro-batch."""
    mixed = stage(df.repartition(5, F.xxhash64(key)), "mixed")
    path = mixed.inputFiles()[0].rsplit("/", 1)[0]
    return df.sparkSession.readStream.schema(mixed.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _live_store(spark, sf) -> tuple[str, DataFrame]:
    """Root of a store after five micro-batches of all alerts."""
    from netloom.streaming import runner

    alerts = _alerts(spark, sf)
    root = run_dir(spark, "live")
    cfg = detect.DetectConfig(incident_seconds=views.INCIDENT_SECONDS, incident_lateness_seconds=400 * 86400.0)
    runner.start_alert_sink(_shuffled_stream(alerts, "alert_id"), root, f"{root}/checkpoint", cfg).awaitTermination()
    return root, _ntz(runner.live_incidents(spark, root, F.current_timestamp(), views.INCIDENT_SECONDS))


@query
def stream_live_incidents(spark, sf):
    """Live incidents after five micro-batches whose alerts come in no order of time."""
    return _live_store(spark, sf)[1].select("src_ip", "start_time", "end_time", "alert_count", "max_severity")


@query
def stream_alert_incidents(spark, sf):
    """Every stored alert with the start of the incident that it belongs to after the last batch; versions are compacted first."""
    from netloom.streaming import runner

    root, _ = _live_store(spark, sf)
    runner.compact_incidents(spark, root)
    live = _ntz(runner.live_incidents(spark, root, F.current_timestamp(), views.INCIDENT_SECONDS))
    return runner.current_alerts(spark, root).join(live.select("incident_id", "start_time"), "incident_id", "left").select("alert_id", "start_time")


@query
def stream_live_stats(spark, sf):
    """The statistics published after the last of five batches of flows and of alerts."""
    from netloom.streaming import live_stats, runner

    root = run_dir(spark, "live-stats")
    cfg = views.config()
    runner.start_flow_sink(_shuffled_stream(_flows(spark, sf), "flow_id"), root, f"{root}/c1", cfg).awaitTermination()
    runner.start_alert_sink(_shuffled_stream(_alerts(spark, sf), "alert_id"), root, f"{root}/c2", cfg).awaitTermination()
    return rounded(live_stats.snapshot(spark, root).where("kind != 'rate'"), 4)


@query
def stream_label_join(spark, sf):
    from netloom.streaming.operators import stream_labels as run
    from netloom.streaming.runner import drain

    f = stage(_flows(spark, sf), "flows")
    a = stage(_near_alerts(spark, sf, f).select("_src_ip", "_dst_ip", "_dst_port", "alert_ts", "label"), "near")

    def again(df, ts):
        path = df.inputFiles()[0].rsplit("/", 1)[0]
        return spark.readStream.schema(df.schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, "0 seconds")

    return drain(run(again(f, "flow_end"), again(a, "alert_ts")).select("flow_id", "label"), "stream-labels")


@query
def stream_label_counts(spark, sf):
    """Flows with their labels and the number of alerts behind each, over five stretches of both streams."""
    from netloom.streaming.label_state import stream_label_counts as run
    from netloom.streaming.runner import drain_in_turns

    f = stage(_flows(spark, sf), "flows")
    a = stage(_near_alerts(spark, sf).select("_src_ip", "_dst_ip", "_dst_port", "alert_ts", "label"), "near")
    (flows, alerts), feeds = _turns(f, "flow_end", (a, "alert_ts"))
    return drain_in_turns(run(flows, alerts), "stream-label-counts", feeds).select("flow_id", "label", "times")


@query
def stream_rates(spark, sf):
    from netloom.streaming.operators import stream_rates as run
    from netloom.streaming.runner import drain_in_turns

    packets, feeds = _packet_turns(spark, sf)
    return _ntz(drain_in_turns(run(packets, "ts", "6 hours", "1 hour"), "stream-rates", feeds))


# ---------------------------------------------------------------- models
# All rows are used. What SQL can state of a model is checked: sizes, and whether its figures reach their bounds.

def _clean_rows(spark, sf) -> DataFrame:
    return training.clean_strict(training.harmonise(views.labelled_lineitem(spark, sf), keep=("row_id",)))


def _train_rows(spark, sf) -> DataFrame:
    """Cleaned public rows as a written table: training reads them many times."""
    return stage(_clean_rows(spark, sf), "train")


def _learnable_rows(spark, sf) -> DataFrame:
    """The same rows with a label that their features tell: large flows of many packets, about one row in nine."""
    attack = ((F.col("packet_count") > 35) & (F.col("src_bytes") > 45_000)).cast("int")
    return stage(_clean_rows(spark, sf).withColumn("is_attack", attack), "learnable")


@query
def rf_score(spark, sf):
    """Default forest on the oversampled training part; per class of the held-out part its size and whether the report is good enough."""
    from netloom.ml import models

    t = ranking.stratified_split(_learnable_rows(spark, sf), "is_attack", ["row_id"])
    forest = models.train_forest(t.where("is_train"), grow="groups")
    scored = stage(models.forest_score(t.where("not is_train"), forest), "scored")
    report, auc = models.evaluate(scored)
    return report.select("class", "support", (F.col("precision") > 0.95).alias("precise"), (F.col("recall") > 0.95).alias("complete"), F.lit(auc > 0.997).alias("auc_good"))


@query
def auc_exact(spark, sf):
    """ROC-AUC of a score with many ties."""
    s = _scored(spark, sf).select(F.floor(F.col("score") * 100).cast("double").alias("score"), ((F.col("rf_score") > 0.6) | (F.col("flow_id") % 7 == 0)).cast("int").alias("is_attack"))
    return ranking.exact_auc(s, "score", "is_attack").select(F.round("auc", 9).alias("auc"), "positives", "negatives")


@query
def forest_balance(spark, sf):
    """Class sizes after oversampling the training part on standardised features."""
    from netloom.ml.smote import oversample
    from netloom.schemas import FEATURE_COLS

    t = ranking.stratified_split(_learnable_rows(spark, sf), "is_attack", ["row_id"]).where("is_train")
    means = t.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURE_COLS], *[F.stddev_samp(c).alias(f"s_{c}") for c in FEATURE_COLS]).first()
    scaled = t.select("row_id", "is_attack", *[((F.col(c) - means[f"m_{c}"]) / (means[f"s_{c}"] or 1.0)).alias(c) for c in FEATURE_COLS])
    return oversample(stage(scaled, "standard"), FEATURE_COLS).groupBy("is_attack").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("row_id", F.lit("~"))).alias("made"))


@query
def anomaly_score(spark, sf):
    """Error and score of all rows by class, model from benign rows, threshold from the held-out part."""
    from netloom.ml import models

    t = ranking.stratified_split(_train_rows(spark, sf), "is_attack", ["row_id"])
    m = models.fit_threshold(t.where("not is_train"), models.train_anomaly(t.where("is_train and is_attack = 0")))
    s = models.anomaly_score(t, m)
    return rounded(s.groupBy("is_attack").agg(F.count(F.lit(1)).alias("n"), F.avg("ae_score").alias("mean_score"), F.max("ae_score").alias("max_score")), 4)


@query
def anomaly_report(spark, sf):
    """Report of "error above the threshold" on the held-out rows."""
    from netloom.ml import models

    t = ranking.stratified_split(_train_rows(spark, sf), "is_attack", ["row_id"])
    m = models.train_anomaly(t.where("is_train and is_attack = 0"))
    held = stage(models.reconstruction_error(t.where("not is_train"), m).select("is_attack", "mse"), "errors")
    return models.anomaly_report(held, models.fit_threshold(held, m, known="mse"), known="mse")


@query
def smote(spark, sf):
    """Class sizes and means after balancing the flows that raised an alert against those that did not."""
    from netloom.ml.smote import oversample
    from netloom.schemas import FEATURE_COLS

    f = stage(views.score_by_id(_flows(spark, sf)), "flows")
    t = features.model_features(f, keep=("flow_id", "score")).select(F.col("flow_id").alias("row_id"), (F.col("score") >= 0.65).cast("int").alias("is_attack"), *FEATURE_COLS)
    out = oversample(t, FEATURE_COLS)
    return rounded(out.groupBy("is_attack").agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("duration"), F.min("src_bytes").alias("least_bytes")), 4)


@query
def scored_pipeline(spark, sf):
    """Own flows scored by both models, then alerts by severity."""
    from netloom.ml import models

    f = stage(_flows(spark, sf), "flows")
    t = features.model_features(f.withColumn("is_attack", (F.col("rst_flag_count") > 0).cast("int")), keep=("is_attack",))
    forest = models.train_forest(t)
    anomaly = models.fit_threshold(t, models.train_anomaly(t.where("is_attack = 0")))
    scored = models.score_flows(f, forest, anomaly)
    return al.raise_alerts(scored, rules.first_match(scored, views.rule_set())).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query
def label_numbers(spark, sf):
    """Labels with their index in alphabetical order."""
    from netloom.ml import models

    return models.label_index(_train_rows(spark, sf)).groupBy("label", "label_index").agg(F.count(F.lit(1)).alias("n"))
