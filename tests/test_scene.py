from tidemark.operators import scene, scoring

NODES = "scene string, node string, kind string, proposition string, status string"
REFS = "scene string, node string, evidence string, channel string, authority string, role string, covered boolean, eligible boolean"
EDGES = "scene string, src string, dst string, relation string, role string"


def tables(spark, nodes, refs, edges=(), conflicts=(), decisions=()):
    return (
        spark.createDataFrame(nodes, NODES),
        spark.createDataFrame(refs, REFS),
        spark.createDataFrame(list(edges), EDGES),
        spark.createDataFrame(list(conflicts), "scene string, conflict string, node string"),
        spark.createDataFrame(list(decisions), "scene string, node string, state string"),
    )


def states(spark, *args, **kw):
    return {r.node: r.after for r in scene.reconcile(*tables(spark, *args, **kw)).collect()}


TEXT = lambda node: ("s", node, "e" + node, "TXT", "canonical_text", None, True, None)


def test_adequacy(spark):
    nodes = [("s", n, "observation", "wording", "PROVISIONAL") for n in "abcdef"]
    refs = [
        TEXT("a"),
        ("s", "b", "e", "VIS", None, None, True, True),
        ("s", "c", "e", "HL", None, None, True, True),
        ("s", "d", "e", "TXT", "canonical_text", None, False, None),
        ("s", "e", "e", "AO_STAGE2", None, None, True, True),
        ("s", "f", "e1", "TXT", "canonical_text", "SUPPORTING", True, None),
        ("s", "f", "e2", "TXT", "fan_text", "REQUIRED", True, None),
    ]
    n, r, *_ = tables(spark, nodes, refs)
    assessed = scene.assess(r, n)
    assert {(x.node, x.evidence): x.reason for x in assessed.collect()} == {("a", "ea"): None, ("b", "e"): "NOT_COMPETENT", ("c", "e"): "NOT_COMPETENT", ("d", "e"): "NOT_COVERED", ("e", "e"): "CONTEXT_ONLY", ("f", "e1"): None, ("f", "e2"): "NOT_QUALIFIED"}
    assert {x.node: x.adequate for x in scene.observation_adequacy(assessed).collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False, "f": False}


def test_affirmation_needs_evidence_and_a_decision(spark):
    nodes = [("s", n, "observation", "wording", "SUPPORTED") for n in "abc"]
    got = states(spark, nodes, [TEXT("a"), TEXT("b")], decisions=[("s", "a", "SUPPORTED"), ("s", "c", "SUPPORTED")])
    assert got == {"a": "SUPPORTED", "b": "OPEN", "c": "OPEN"}


def test_a_change_spreads_and_prerequisites_gate(spark):
    nodes = [("s", "a", "observation", "wording", "PROVISIONAL"), ("s", "b", "observation", "wording", "PROVISIONAL"), ("s", "c1", "claim", "wording", "SUPPORTED"), ("s", "c2", "claim", "wording", "SUPPORTED"), ("s", "c3", "claim", "wording", "SUPPORTED"), ("t", "c1", "claim", "wording", "SUPPORTED")]
    edges = [("s", "a", "c1", "SUPPORTS", "REQUIRED"), ("s", "c1", "c2", "DEPENDS_ON", None), ("s", "b", "c3", "SUPPORTS", "REQUIRED")]
    n, r, e, c, d = tables(spark, nodes, [TEXT("a"), TEXT("b")], edges, decisions=[("s", "a", "CONTRADICTED")])
    got = {(x.scene, x.node): x.after for x in scene.reconcile(n, r, e, c, d).collect()}
    # c3 stands on an observation that never changed and never was affirmed.
    assert got == {("s", "a"): "CONTRADICTED", ("s", "b"): "PROVISIONAL", ("s", "c1"): "RECHECK", ("s", "c2"): "RECHECK", ("s", "c3"): "OPEN", ("t", "c1"): "SUPPORTED"}


def test_supplementary_edges_do_not_gate(spark):
    nodes = [("s", "a", "observation", "wording", "PROVISIONAL"), ("s", "c", "claim", "wording", "SUPPORTED")]
    assert states(spark, nodes, [TEXT("a")], [("s", "a", "c", "SUPPORTS", "SUPPLEMENTARY")])["c"] == "SUPPORTED"


def test_conflicts(spark):
    nodes = [("s", n, "observation", "wording", "PROVISIONAL") for n in "ab"]
    refs, rivals = [TEXT("a"), TEXT("b")], [("s", "x", "a"), ("s", "x", "b")]
    both = states(spark, nodes, refs, conflicts=rivals, decisions=[("s", "a", "SUPPORTED"), ("s", "b", "SUPPORTED")])
    assert both == {"a": "OPEN", "b": "OPEN"}
    one = states(spark, nodes, refs, conflicts=rivals, decisions=[("s", "a", "SUPPORTED"), ("s", "b", "CONTRADICTED")])
    assert one == {"a": "SUPPORTED", "b": "CONTRADICTED"}
    assert states(spark, nodes, refs, conflicts=rivals, decisions=[("s", "a", "SUPPORTED")])["a"] == "OPEN"


def test_agreement(spark):
    rows = [("s", "p", "a", "o1", False, True), ("s", "p", "b", "o2", False, True), ("s", "q", "a", "o1", False, True), ("s", "q", "b", "o1", False, True), ("s", "r", "a", "o1", True, True), ("s", "t", "a", "o1", False, True)]
    df = spark.createDataFrame(rows, "scene string, proposition string, node string, origin string, contextual boolean, declared boolean")
    assert {r.proposition: r.agreement for r in scene.agreement(df).collect()} == {"p": "INDEPENDENT_CORROBORATION", "q": "DEPENDENT_CONSISTENCY", "r": "CONTEXT_INFLUENCED_OBSERVATION", "t": "INDEPENDENCE_NOT_ESTABLISHED"}


def test_plan(spark):
    rows = [("s", "c1", 1, "motion", 0.0, 100.0, "OPEN"), ("s", "c2", 2, "contact", 0.0, 100.0, "OPEN"), ("s", "c3", 3, "motion", 0.0, 100.0, "OPEN"), ("s", "c4", 4, "motion", 0.0, 90.0, "OPEN"), ("s", "c5", 5, "delivery", 0.0, 31.0, "OPEN"), ("s", "c6", 6, "visual_fact", 0.0, 1.0, "SUPPORTED"), ("s", "c7", 7, "motion", 0.0, 20.0, "OPEN")]
    df = spark.createDataFrame(rows, "scene string, claim string, ord int, proposition string, start_s double, end_s double, state string")
    got = {r.claim: (r.status, r.request, r.frames) for r in scene.plan_queries(df, max_frames=450).collect()}
    assert got == {"c1": ("PLANNED", 1, 200), "c2": ("PLANNED", 2, 200), "c3": ("MERGED", 1, 0), "c4": ("OPEN_RESOURCE_CEILING", None, 0), "c5": ("OPEN_REFINE_INTERVAL", None, 0), "c7": ("PLANNED", 3, 40)}


def test_delta_needs_new_evidence(spark):
    st = lambda rows: spark.createDataFrame(rows, "scene string, node string, after string")
    wit = lambda rows: spark.createDataFrame(rows, "scene string, node string, origin string, start_s double, end_s double")
    out = scene.delta(
        st([("s", "a", "OPEN"), ("s", "b", "OPEN"), ("s", "c", "OPEN")]), st([("s", "a", "SUPPORTED"), ("s", "b", "SUPPORTED"), ("s", "d", "OPEN")]),
        wit([("s", "a", "o", 0.0, 2.0)]), wit([("s", "a", "o", 0.0, 1.0), ("s", "a", "o", 1.0, 2.0), ("s", "b", "o", 0.0, 1.0)]),
    )
    assert {r.node: (r.change, r.new_evidence) for r in out.collect()} == {"a": ("CHANGED", False), "b": ("CHANGED", True), "c": ("REMOVED", False), "d": ("ADDED", False)}


def test_qualification(spark):
    def trials(name, pos, neg, amb, natural=True, split="held_out"):
        rows = []
        for control, good, bad, said in (("POSITIVE", *pos, "ABSENT"), ("NEGATIVE", *neg, "PRESENT"), ("AMBIGUOUS", *amb, "PRESENT")):
            rows += [(name, split, control, "X", True, natural)] * good + [(name, split, control, said, False, natural)] * bad
        return rows

    rows = trials("ok", (10, 0), (8, 0), (2, 0)) + trials("fp", (10, 0), (7, 1), (2, 0)) + trials("few", (6, 0), (6, 0), (2, 0)) + trials("lab", (10, 0), (8, 0), (2, 0), False) + trials("dev", (3, 0), (3, 0), (3, 0), True, "development") + trials("amb", (10, 0), (8, 0), (1, 1))
    df = spark.createDataFrame(rows, "name string, split string, control string, prediction string, correct boolean, natural boolean")
    got = {r.name: r.status for r in scoring.qualification(df, ["name"]).collect()}
    assert got == {"ok": "VALIDATED_ON_BENCHMARK", "fp": "FAILED", "few": "PROVISIONAL", "lab": "PROVISIONAL", "dev": "NOT_TESTED", "amb": "FAILED"}


def test_ablation(spark):
    c = spark.createDataFrame([(1, "a", "SUPPORTED", 1), (1, "b", "OPEN", 0), (1, "c", "SUPPORTED", 0), (2, "a", "SUPPORTED", 1), (2, "b", "SUPPORTED", 2), (2, "c", "SUPPORTED", 1)], "pass_no int, claim string, status string, n_evidence int")
    g = spark.createDataFrame([("a", "SUPPORTED"), ("b", "OPEN")], "claim string, status string")
    got = {r.pass_no: (r.new_supported, r.false_claims, r.unadjudicated, r.abstentions) for r in scoring.ablation_evaluation(c, g).collect()}
    assert got == {1: (["a"], [], [], ["b"]), 2: ([], ["b"], ["c"], [])}
