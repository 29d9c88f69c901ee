from __future__ import annotations

import random

from tests.conftest import rows

from keyfathom.operators import callgraph as cg

FUNCTIONS = "repo_id string, file_path string, func_id string, name string, label string, start_line int, end_line int, is_entry boolean"
CALLS = "repo_id string, caller string, callee_name string"


def breadth_first(functions, calls):
    """Depth and smallest chain per function, by plain search level by level."""
    by_name, called = {}, {}
    for f in functions:
        by_name.setdefault((f[0], f[3]), []).append(f)
    for repo, caller, name in calls:
        called.setdefault((repo, caller), set()).add(name)
    best = {(f[0], f[2]): (0, [f[4]]) for f in functions if f[7]}
    level = dict(best)
    depth = 0
    while level:
        depth += 1
        found = {}
        for (repo, fid), (_, chain) in level.items():
            for name in called.get((repo, fid), ()):
                for g in by_name.get((repo, name), []):
                    key = (repo, g[2])
                    if key not in best:
                        longer = (chain + [g[4]])[-cg.MAX_CHAIN:]
                        if key not in found or longer < found[key][1]:
                            found[key] = (depth, longer)
        best.update(found)
        level = found
    return best


def test_reach_equals_plain_search(spark):
    rng = random.Random(5)
    functions, calls = [], []
    for repo in ("a", "b"):
        for n in range(120):
            name = f"f{rng.randint(0, 60)}"
            functions.append((repo, f"m{n % 9}.py", f"{repo}{n}", name, f"{name}@{n}", n, n + 1, rng.random() < 0.03))
            for _ in range(rng.randint(0, 2)):
                calls.append((repo, f"{repo}{n}", f"f{rng.randint(0, 75)}"))
    got = cg.reach(spark.createDataFrame(functions, FUNCTIONS), spark.createDataFrame(calls, CALLS))
    got = {(r.repo_id, r.func_id): (r.depth, list(r.chain)) for r in got.collect()}
    want = breadth_first(functions, calls)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: len(v[1]) for k, v in got.items()} == {k: len(v[1]) for k, v in want.items()}
    assert got == want


def test_one_name_borne_by_a_third_of_all_functions(spark):
    functions = [("r", "a.py", str(n), "get" if n % 3 == 0 else f"g{n}", f"x@{n}", n, n, n == 1) for n in range(3000)]
    calls = [("r", str(n), "get") for n in range(3000)]
    got = cg.reach(spark.createDataFrame(functions, FUNCTIONS), spark.createDataFrame(calls, CALLS))
    assert got.groupBy("depth").count().orderBy("depth").collect() == [(0, 1), (1, 1000)]


def test_chain_is_cut_to_its_end(spark):
    n = 70
    functions = [("r", "a.py", str(k), f"f{k}", f"f{k}", k, k, k == 0) for k in range(n)]
    calls = [("r", str(k), f"f{k + 1}") for k in range(n)]
    got = cg.reach(spark.createDataFrame(functions, FUNCTIONS), spark.createDataFrame(calls, CALLS))
    last = got.where("depth = 69").first()
    assert list(last.chain) == [f"f{k}" for k in range(20, 70)]


def test_tightest_span(spark):
    rng = random.Random(8)
    functions = []
    for n in range(200):
        start = rng.randint(1, 5000)
        end = start + rng.choice([0, 1, 7, 8, 9, 63, 64, 300, 4000, 100_000, -1])
        functions.append(("r", f"f{n % 3}", f"id{n:03}", "x", "x", start, end, False))
    lines = [("r", f"f{n % 3}", rng.randint(1, 6000)) for n in range(500)] + [("r", "f0", 1)]
    want = {}
    for _, path, line in lines:
        around = [(f[6] - f[5], f[2]) for f in functions if f[1] == path and f[5] <= line <= f[6]]
        if around:
            want[(path, line)] = min(around)[1]
    got = cg.enclosing_functions(spark.createDataFrame(lines, "repo_id string, file_path string, line_number int"),
                                 spark.createDataFrame(functions, FUNCTIONS))
    assert {(r.file_path, r.line_number): r.func_id for r in got.collect()} == want


def test_module_level_and_repositories_without_entries(spark):
    functions = spark.createDataFrame([("r", "a.py", "a::f@3", "f", "f@3", 3, 5, False), ("r", "a.py", "a::main@7", "main", "main@7", 7, 9, True),
                                       ("none", "a.py", "z", "z", "z", 1, 2, False)], FUNCTIONS)
    calls = spark.createDataFrame([("none", "z", "z")], CALLS)
    found = spark.createDataFrame([("r", "a.py", 1, "source_code"), ("r", "a.py", 4, "source_code"), ("r", "a.py", 8, "source_code"),
                                   ("r", "a.py", 8, "dependency"), ("none", "a.py", 1, "source_code")],
                                  "repo_id string, file_path string, line_number int, source_type string")
    got = cg.verdicts(found, functions, cg.reach(functions, calls))
    assert rows(got, "line_number", "reachable", "call_depth") == [(1, True, 0), (4, False, None), (8, True, 0)]
    assert {tuple(r.call_chain) for r in got.collect()} == {("<module-level>",), (), ("main@7",)}


def test_python_extraction(spark):
    source = '''
class A:
    @router.get("/x")
    async def view(self):
        return load(self.db.fetch())

def test_it():
    pass

def helper():
    def inner(): other()
    inner()

if __name__ == "__main__":
    helper()
'''
    files = spark.createDataFrame([("r", "a.py", source), ("r", "bad.py", "def ("), ("r", "b.go", "func main() {}")],
                                  "repo_id string, file_path string, content string")
    got = {r.label: r for r in cg.python_functions(files).collect()}
    assert set(got) == {"view@4", "test_it@7", "helper@10", "inner@11", "__main__"}
    assert {k for k, r in got.items() if r.is_entry} == {"view@4", "test_it@7", "__main__"}
    assert got["helper@10"].callees == ["inner", "other"]
    assert (got["view@4"].end_line, got["view@4"].callees) == (5, ["fetch", "get", "load"])


def test_handler_names_become_entries(spark):
    go = "package a\n\nfunc setup() {\n  http.HandleFunc(p, nil)\n  Serve(x)\n}\n\nfunc Serve(x int) {\n  Sign(x)\n}\n\nfunc Sign(x int) {}\n"
    files = spark.createDataFrame([("r", "a.go", go)], "repo_id string, file_path string, content string")
    extracted = cg.extract(files)
    functions = cg.functions_of(extracted)
    assert rows(functions.where("is_entry"), "name") == [("Serve",)]
    reached = cg.reach(functions, cg.calls_of(extracted))
    assert rows(reached, "func_id", "depth") == [("a.go::Serve@8", 0), ("a.go::Sign@12", 1)]


def test_a_round_moves_only_what_the_frontier_calls(spark):
    """Edges and unsettled names stay in place, also from round to round."""
    parts = cg._partitions(spark)
    edges = cg._placed(spark.createDataFrame([("r", f"n{i}", f"n{i + 1}", f"n{i}@1") for i in range(50)],
                                             "repo_id string, name string, callee string, label string"), parts, dealt=False)
    unsettled = cg._placed(spark.createDataFrame([("r", f"n{i}") for i in range(1, 51)], "repo_id string, name string"), parts, dealt=False)
    frontier = cg._placed(spark.createDataFrame([("r", "n0", ["e"], 1)], "repo_id string, name string, chain array<string>, depth int"), parts, dealt=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for depth in (2, 3):
            step = cg.next_frontier(frontier, edges, unsettled, depth)
            plan = step._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 2, plan
            unsettled = unsettled.join(frontier, ["repo_id", "name"], "left_anti")
            assert "Exchange" not in unsettled._jdf.queryExecution().executedPlan().toString()
            unsettled, frontier = cg._placed(unsettled, parts), cg._placed(step, parts)
            assert rows(frontier, "name", "chain") == [(f"n{depth - 1}", ["e", *[f"n{i}@1" for i in range(depth - 1)]])]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_outside_functions_do_not_meet_the_reached_ones(spark, table):
    functions = table(FUNCTIONS, ("r", "a.py", "f", "main", "main@1", 1, 3, True), ("q", "a.py", "g", "g", "g@1", 1, 3, False))
    calls = table(CALLS, ("r", "f", "g"))
    found = table("repo_id string, file_path string, line_number int, source_type string",
                  ("r", "a.py", 2, "source_code"), ("r", "a.py", 9, None), ("q", "a.py", 2, "source_code"), ("r", "b", 1, "dependency"))
    out = cg.verdicts(found, functions, cg.reach(functions, calls))
    assert rows(out, "repo_id", "line_number", "func_id", "reachable", "call_depth", "call_chain") == [
        ("r", 2, "f", True, 0, ["main@1"]), ("r", 9, None, True, 0, [cg.MODULE_LEVEL])]
    assert "isnotnull(func_id" in out._jdf.queryExecution().optimizedPlan().toString()
