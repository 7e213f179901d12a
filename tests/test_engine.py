"""Laws, judge, damages and sampling on small graphs; the queries against their SQL."""

import glob
import itertools
import os
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom import _cut
from factloom.functions import arrays, documents, scalars, text
from factloom.operators import canon, damage, judge, laws, repair, sampling
from factloom.plans import driver
from factloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"


def _nodes(spark, rows):
    schema = "id string, celex string, date_document string, date_end_of_validity string, gap boolean, labels array<string>"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("date_document_status", scalars.date_status(F.col("date_document"), F.col("celex")))


@pytest.fixture(scope="module")
def graph(spark):
    nodes = _nodes(
        spark,
        [
            ("a", "32000L0001", "2000-01-01", None, False, ["Directive"]),
            ("b", "32001R0002", "2001-05-05", "2002-01-01", False, ["Regulation"]),
            ("c", "32003D0003", "2003-02-28", None, False, ["Directive"]),
            ("d", "", "2019-02-30", None, False, []),
            ("g", None, "", None, True, []),
        ],
    )
    facts = spark.createDataFrame(
        [("1", "a", "repeals", "b"), ("2", "b", "repeals", "a"), ("3", "b", "amends", "c"), ("4", "c", "based_on", "d"), ("5", "c", "based_on", "g"), ("6", "c", "based_on", "zz"), ("7", "c", "repeals", "c")],
        "id string, s string, p string, o string",
    )
    return facts, nodes


def test_laws(graph):
    facts, nodes = graph
    got = {r["id"]: r["laws"] for r in laws.violations(facts, nodes).collect()}
    assert got == {"1": ["L4", "L1"], "2": ["L4"], "3": ["L1", "L2"], "4": ["L3"], "5": [], "6": ["L3"], "7": ["L4"]}
    assert [(r["id"], r["wrong"]) for r in laws.label_violations(nodes).collect()] == [("c", ["Directive"])]
    assert {r["id"] for r in repair.rule_only(facts, nodes).collect()} == {"5"}


def test_date_status_and_dates(spark):
    rows = spark.createDataFrame([("2019", "x"), ("20190105", "x"), ("2020-02-29", "32020L1"), ("1949-12-31", "x"), ("2000-01-01", "32015L0001"), ("", "x")], "d string, k string")
    got = rows.select(scalars.date_status(F.col("d"), F.col("k")).alias("s"), scalars.next_year(F.col("d")).alias("n")).collect()
    assert [r["s"] for r in got] == ["sentinel", "sentinel", "ok", "sentinel", "inconsistent", "missing"]
    assert got[2]["n"] == "2021-02-28"


def test_counts_and_ratios():
    assert scalars.share_count("0.10", 14411) == 1441 and scalars.share_count("1/2", 1441) == 720 and scalars.share_count("1/2", 6429) == 3214
    assert scalars.share_count("40", 1000, True) == 40
    assert (scalars.ratio_text(1, 32), scalars.ratio_text(0, 0), scalars.ratio_text(1, 20000)) == ("0.0312", "undefined", "0.0001")


def test_perfect_and_empty_candidates(spark, graph):
    facts, nodes = graph
    none = facts.limit(0).select("s", "p", "o")
    faults = spark.createDataFrame([("6", None, "empty_target", 1)], "fact string, node string, kind string, seq int")
    world = spark.createDataFrame([("repeals", True), ("amends", True), ("based_on", False)], "p string, closed boolean")
    gaps = nodes.where("gap").select(F.col("id").alias("node"))

    def dims(candidate, silent=none):
        status = judge.fact_status(facts, candidate, faults, silent)
        return {r["p"]: r for r in judge.dimensions(status, judge.extra_status(facts, candidate, nodes, gaps, world), world).collect()}

    d = dims(facts.select("s", "p", "o"))
    assert all(r["found"] == r["n_truth"] and not r["missed"] for r in d.values()) and d["based_on"]["n_truth"] == 2 and d["based_on"]["known_fault"] == 1
    d = dims(none, facts.select("s", "p", "o"))
    assert all(r["abstained"] == r["n_truth"] for r in d.values())
    extra = spark.createDataFrame([("a", "repeals", "c"), ("a", "repeals", "c"), ("a", "amends", "g"), ("a", "amends", "q"), ("a", "based_on", "b"), ("a", "cites", "b")], "s string, p string, o string")
    d = dims(facts.select("s", "p", "o").unionByName(facts.where("id = '1'").select("s", "p", "o")).unionByName(extra))
    assert (d["repeals"]["duplicate"], d["repeals"]["false_facts"]) == (1, 2)
    assert (d["amends"]["out_of_coverage"], d["amends"]["unresolved"], d["based_on"]["out_of_coverage"]) == (1, 1, 1)
    with pytest.raises(ValueError):
        judge.bound("a", "b", "truth")


def test_sample_is_exact_and_free_of_order(spark):
    df = spark.range(1000).withColumn("k", F.col("id").cast("string"))
    a = {r["id"] for r in sampling.sample(df, F.col("k"), 77, "s").collect()}
    b = {r["id"] for r in sampling.sample(df.repartition(7), F.col("k"), 77, "s").collect()}
    assert len(a) == 77 and a == b and sampling.sample(df, F.col("k"), 5000, "s").count() == 1000 and sampling.sample(df, F.col("k"), 0, "s").count() == 0


def test_unknown_damage_is_refused():
    assert damage.parse(["x:SPLIT=1/2"])[0].kind == "SPLIT"
    with pytest.raises(ValueError):
        damage.parse(["x:NOTHING=0.1"])


def test_canonical_json():
    assert canon.dumps({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'
    with pytest.raises(TypeError):
        canon.dumps({"a": 1.5})


def test_verdict_does_not_follow_order(spark, graph, tmp_path):
    facts, nodes = graph
    parts = lambda n: {"facts": facts.repartition(n).orderBy(F.rand(n)), "extra": facts.limit(0)}
    one, two = (judge.verdict({"truth": "t"}, parts(n)) for n in (1, 3))
    assert one == two and one["facts"]["n"] == 7 and one["sha256"] == canon.digest({k: v for k, v in one.items() if k != "sha256"})
    assert judge.verdict({"truth": "t"}, {"facts": facts.where("id <> '1'"), "extra": facts.limit(0)})["sha256"] != one["sha256"]
    canon.write(f"{tmp_path}/v.json", one)
    with open(f"{tmp_path}/v.json", encoding="utf-8") as f:
        text = f.read()
    assert text.startswith('{\n "') and text.endswith("}\n")
    assert [r["id"] for r in judge.ordered(facts.repartition(5), "s", "p", "o").select("id").collect()] == ["1", "3", "2", "4", "5", "6", "7"]


def test_twins_and_faults_by_law(spark, graph):
    facts, nodes = graph
    journal = spark.createDataFrame([("SPLIT", "a#split", ["1", None]), ("SPLIT", "b#split", ["2", "3"]), ("MERGE", None, None)], "damage string, twin string, moved_facts array<string>")
    got = {r["outcome"]: r["n"] for r in judge.twins(journal, nodes.select(F.concat("id", F.lit("#split")).alias("id")).where("id = 'b#split'")).collect()}
    assert got == {"deleted": 1, "kept": 1, "true facts it took, not restored": 3}
    faults = spark.createDataFrame([("1", None, "law_violation", 1), ("6", None, "empty_target", 1), ("7", None, "law_violation", 1)], "fact string, node string, kind string, seq int")
    status = judge.fact_status(facts, facts.where("id = '7'").select("s", "p", "o"), faults, facts.limit(0).select("s", "p", "o"))
    assert judge.known_violations_removed(status).collect()[0][0] == 1


def _stated(spark, texts, keys, relation="repeals"):
    rows = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, keys))], "i int, text string, keys array<string>")
    return [r["class"] for r in sorted(text.stated(rows, relation).collect(), key=lambda r: r["i"])]


def test_statements(spark):
    keys = ["12/2004", "2004/12"]
    cases = {
        "Regulation 12/2004 is hereby repealed.": "stated",
        "See Regulation 12/2004 of the Council.": "named_only",
        "See Regulation 112/2004 of the Council.": "not_named",
        "The following are repealed:\n Regulation one thing;\n Council act of 12/2004 and so on;": "stated_in_list",
        "12/2004 something follows; the act 13/2004 is repealed": "named_only",
        "12/2004 something follows;\n in the year of it\n is repealed": "stated",
        "": "no_text",
    }
    assert _stated(spark, [*cases, "x 12/2004", None], [keys] * len(cases) + [[], keys]) == [*cases.values(), "no_key", "no_text"]
    annex = "x" * 10 + " ANNEX II repealed acts CORRELATION TABLE y ANNEX V act repealed" + "z" * 9000
    spans = spark.createDataFrame([(annex,)], "t string").select(text.annexes(F.col("t"), "repeals").alias("s")).collect()[0]["s"]
    assert [(x["start"], x["end"]) for x in spans] == [(11, annex.index("CORRELATION")), (annex.index("ANNEX V"), annex.index("ANNEX V") + len("ANNEX V act repeal") + 8000)]


def test_places_and_running_totals(spark):
    words = " ".join(f"w{k}é" if k % 3 else "😀b" for k in range(1000))
    got = spark.createDataFrame([(words,)], "t string").select(arrays.places(F.col("t"), F.lit("😀b|w1")).alias("p"), arrays.spliced(F.col("t"), F.lit("😀b"), lambda m, i: F.concat(m, i.cast("string"))).alias("x")).collect()[0]
    assert [(x["start"], x["value"]) for x in got["p"]] == [(m.start(), m[0]) for m in re.finditer("😀b|w1", words)]
    count = iter(range(10_000))
    assert got["x"] == re.sub("😀b", lambda m: m[0] + str(next(count)), words)
    nums = [k * 7 % 13 for k in range(300)]
    totals = spark.createDataFrame([(nums[:n],) for n in (0, 1, 64, 65, 300)], "v array<int>").select(arrays.running(F.col("v"), F.lit(0), lambda a, b: a + b).alias("r")).collect()
    assert [r["r"] for r in totals] == [[sum(nums[:k]) for k in range(n)] for n in (0, 1, 64, 65, 300)]


def test_document_forms_keep_markup(spark):
    xml = '<a><article-id pub-id-type="doi">10.1/x</article-id><title-group><article-title>T</article-title></title-group><contrib contrib-type="author"><surname>Shao</surname><given-names>Xi</given-names></contrib><contrib contrib-type="author"><surname>Chen</surname><given-names>Yu</given-names></contrib><pub-date><year>2001</year></pub-date><pub-date><day>2001</day><year>2001</year></pub-date><date><year>2001</year></date></a>'
    docs = spark.createDataFrame([("n", xml), ("none", "<a></a>"), (None, None)], "name string, xml string")
    for form in documents.FORMS:
        rows = {r["name"]: r for r in documents.inject(docs, [form], "s").collect()}
        event, out = rows["n"]["events"][0], rows["n"]["damaged"]
        assert event["skipped"] == (out == xml) and (form == "form-026" or event["skipped"] == (form == "form-191"))
        assert rows["none"]["damaged"] == "<a></a>" and rows["none"]["events"][0]["skipped"] and rows[None]["damaged"] is None
        if form == "form-198":
            assert "<year>2001</year></pub-date>" not in out and out.endswith("<date><year>2001</year></date></a>")
        if form == "form-107":
            assert out.count("10.1/x.r00") == 1 and out.count("10.1/x") == 2
        if form == "form-118":
            assert out.replace("\u200b", "") == xml and out.count("\u200b") == 1
    counts = spark.createDataFrame([(xml, "year", "2001"), (xml, "authors", "x"), (xml, "doi", ""), (xml, "title", "T")], "x string, f string, v string")
    assert [r[0] for r in counts.select(documents.declarations(F.col("x"), F.col("f"), F.col("v")).alias("n")).collect()] == [2, None, None, 1]
    judged = documents.judge(documents.inject(docs.limit(1), ["form-107", "form-120"], "s"), documents.read_all)
    assert {r["field"]: r["state"] for r in judged.collect()} == {"doi": "flagged", "year": "held", "title": "held", "authors": "flagged"}
    outcome = documents.outcomes(judged).collect()[0]
    assert (outcome["flagged"], outcome["side_effects"], outcome["shielded"]) == (["authors", "doi"], [], [])


def _rows(frame, columns):
    return sorted(tuple("None" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", ["law_l1_ships_census", "law_violations_census", "judge_dimensions", "judge_extra", "damage_wrong_label", "repair_greedy_pairs", "sequential_fact_ids", "audit_majority", "n_triples_scan", "path_of_bounded_length", "damage_rival", "spread_of_runs", "document_judge", "text_stated", "judge_repair_buckets"])
def test_queries_match_sql(spark, name):
    base = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        base.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    want = base.sql(plans.oracle_sql()[name]).df()
    got = plans.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got, sorted(want.columns)) == _rows(want, sorted(want.columns))


def test_greedy_deletions_follow_conflict_order(spark):
    rng = random.Random(5)
    weight = {f"e{k}": rng.randint(1, 4) for k in range(40)}
    groups = {f"c{k:03}": rng.sample(sorted(weight), 3) for k in range(90)}
    rows = spark.createDataFrame([(c, e, weight[e]) for c, es in groups.items() for e in es] * 2, "conflict_id string, element_id string, weight long")
    want = set()
    for c in sorted(groups):
        if not want & set(groups[c]):
            want.add(min(groups[c], key=lambda e: (weight[e], e)))
    assert sorted(r["element_id"] for r in repair.deletions(rows).collect()) == sorted(want)
    best = {r["element_id"] for r in repair.deletions(rows, exact=True).collect()}
    assert all(best & set(g) for g in groups.values()) and sum(weight[e] for e in best) <= sum(weight[e] for e in want)
    alone = repair.deletions(rows.where("conflict_id = 'c000'"), exact=True).collect()
    assert len(alone) == 1 and alone[0]["exact"] and alone[0]["optimum_unique"] == (sorted(weight[e] for e in groups["c000"])[:2].count(alone and min(weight[e] for e in groups["c000"])) == 1)


def _plain_least(groups, weight):
    """(weight, names, unique) of the least hitting set, by trying all sets."""
    names, found = sorted(weight), []
    for k in range(len(names) + 1):
        for pick in itertools.combinations(names, k):
            if all(set(pick) & g for g in groups):
                found.append((sum(weight[x] for x in pick), pick))
    found.sort()
    return found[0][0], found[0][1], len(found) == 1 or found[1][0] > found[0][0]


def test_least_hitting_sets_match_all_sets():
    rng = random.Random(9)
    for _ in range(200):
        weight = {f"e{k}": rng.randint(1, 4) for k in range(rng.randint(2, 8))}
        groups = [frozenset(rng.sample(sorted(weight), rng.randint(1, min(3, len(weight))))) for _ in range(rng.randint(1, 7))]
        weight = {x: weight[x] for x in set().union(*groups)}
        cost, names, unique = _plain_least(groups, weight)
        assert repair.least_hitting_set(groups, weight) == (frozenset(names), unique)
    assert repair.least_hitting_set([frozenset(f"{k}{j}" for j in range(6)) for k in range(40)], {f"{k}{j}": 1 for k in range(40) for j in range(6)}, steps=100) is None


def test_deletions_by_component_are_the_least(spark):
    """Over all acts: the paths through a gap, each component tried with all sets of its edges."""
    facts = {(r["s"], r["p"], r["o"]) for r in driver.act_facts(spark, DATA).collect()}
    gap = {r["id"]: r["gap"] for r in driver.acts(spark, DATA).collect()}
    paths = {frozenset(("|".join(e), "|".join(f))) for e in facts for f in facts if e != f and e[2] == f[0] and {e[0], e[2], f[2]} <= set(gap) and any(gap[x] for x in (e[0], e[2], f[2]))}
    got = plans.queries()["repair_deletions_by_component"](spark, DATA).collect()
    gone = {r["element_id"] for r in got}
    assert paths and all(p & gone for p in paths) and all(r["exact"] for r in got)
    left, cost = list(paths), 0
    while left:
        own = [left.pop()]
        while more := [p for p in left if any(p & q for q in own)]:
            own += more
            left = [p for p in left if p not in more]
        cost += _plain_least(own, dict.fromkeys(set().union(*own), 2))[0]
    assert cost == 2 * len(gone)


def test_components_of_a_long_chain(spark):
    rows = spark.createDataFrame([(f"c{k:03}", f"e{e}") for k in range(150) for e in (k, k + 1)] + [("d", "x")], "conflict_id string, element_id string")
    got = {r["conflict_id"]: r["component"] for r in repair.components(rows).collect()}
    assert len(got) == 151 and {c for k, c in got.items() if k != "d"} == {"c000"} and got["d"] == "d"


def test_large_tables_are_not_broadcast(spark, graph):
    facts, nodes = graph
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()
    many = _cut.cut(spark.range(_cut.SMALL + 1).selectExpr("concat('o:', id) as id"), "many")
    few = _cut.cut(spark.range(9).selectExpr("concat('o:', id) as id"), "few")
    assert "BroadcastHashJoin" not in plan(many.join(many.where("id <> 'o:1'").select("id").distinct(), "id", "left_anti"))
    assert "BroadcastHashJoin" in plan(many.unionByName(few).join(few, "id", "left_semi"))
    assert "BroadcastHashJoin" not in plan(laws.violations(facts, nodes))


def test_fact_ids_have_the_form_of_the_sql(spark, monkeypatch):
    """Beyond 999,999, as if the facts began there."""
    ids = sampling.sequential_ids
    later = lambda df, order, form, out="id": ids(df, order, "%d", "_n").withColumn(out, F.format_string(form, F.col("_n").cast("long") + 1_234_567)).drop("_n")
    monkeypatch.setattr(sampling, "sequential_ids", later)
    got = {r["id"] for r in plans.queries()["sequential_fact_ids"](spark, DATA).collect()}
    n = spark.read.parquet(f"{DATA}/orders.parquet").count()
    want = duckdb.sql(f"select distinct 'f-' || lpad(cast(k + 1234567 as varchar), 6, '0') as id from range(1, {2 * n}) r(k)").df()["id"]
    assert got <= set(want) and all(len(x) == 8 for x in got)


def test_clean_decodes_the_references_of_the_sql(spark, tmp_path):
    html = ["a &amp b &am", "x &amp;amp; &amp;lt; &#39;&quot;&nbsp;\t y", "R&amp;D &copy 2 &copy; &middot;&mdash;&#8217;", "<p>a</p><script>x</script>b<style></style></li>c <b", None, ""]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"create or replace view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = duckdb.sql(plans.oracle_sql()["text_clean"]).df()
    got = plans.queries()["text_clean"](spark, str(tmp_path)).toPandas()
    assert _rows(got, sorted(want.columns)) == _rows(want, sorted(want.columns))
    assert spark.range(1).select(text.clean(F.lit("&mdash; &amp b"))).head()[0] == "— & b"


def test_documents_are_damaged_once_over_many_tasks(spark):
    rows = plans.queries()["document_judge"](spark, DATA)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("raise_error") == 1
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1 and driver.tasks(spark) == 16


def test_law_checks_shuffle_short_rows(spark, graph):
    facts, nodes = graph
    odd = spark.createDataFrame([("8", None, "repeals", "a"), ("9", "a", None, "b"), ("10", "a", "repeals", "b"), ("11", "zz", "amends", "a")], "id string, s string, p string, o string")
    rows = laws.violations(facts.unionByName(odd), nodes)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2  # of each end; a fact by itself is in no third
    got = {r["id"]: r["laws"] for r in rows.collect()}
    assert got == {"1": ["L4", "L1"], "2": ["L4"], "3": ["L1", "L2"], "4": ["L3"], "5": [], "6": ["L3"], "7": ["L4"], "8": [], "9": [], "10": ["L4", "L1"], "11": []}


def test_only_what_a_damage_changes_is_written(spark, graph, monkeypatch):
    facts, nodes = graph
    written = []
    monkeypatch.setattr(damage, "cut", lambda df, name: (written.append(name), _cut.cut(df, name))[1])
    damage.inject(facts, nodes, spark.createDataFrame([], "fact string, node string, kind string, seq int"), damage.parse(["nodes:ANACHRONISM=0.5", "repeals:MISSING=0.5"]), "x")
    assert (written.count("facts"), written.count("nodes"), written.count("events")) == (1, 1, 2)
