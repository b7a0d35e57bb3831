import random

from lexaudit.llm.chat import format_conversations, linear_tree, read_back


def test_best_branches(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for c, n in enumerate([1, 2, 12, 30, 60]):
        parent = {0: None} | {i: rng.choice([i - 1, i - 1, rng.randrange(i)]) for i in range(1, n)}
        score = {i: rng.random() for i in range(n)}
        rows += [(c, i, p, "user" if i % 2 == 0 else "assistant", f"{i}", score[i]) for i, p in parent.items()]
        leaves = set(parent) - set(parent.values())
        paths = []
        for leaf in leaves:
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            paths.append(path[::-1])
        want[c] = sorted(paths, key=lambda p: (-sum(score[i] for i in p) / len(p), -len(p), p[-1]))[:3]
    rows += [(99, 1, 2, "a", "x", 0.0), (99, 2, 1, "b", "y", 0.0), (98, 5, 77, "user", "orphan", None)]
    tree = spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, role string, text string, score double")
    got: dict = {}
    for r in read_back(format_conversations(tree, 3)).orderBy("conv_id", "branch").collect():
        got.setdefault(r.conv_id, []).append([t.text for t in r.turns])
    assert got.pop(98) == [["orphan"]] and 99 not in got
    assert got == {c: [[str(i) for i in p] for p in paths] for c, paths in want.items()}


def test_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>user\n", "\\", "\\\\|<|", "<\\|", "", None, "line\nline", "🙂<|im_start|>", "\\n", "a<||>b"]
    rows = [(c, t, r, texts[(c + t) % len(texts)]) for c in range(10) for t, r in enumerate(["user", "assistant", "we\nird\\n<|role", None, "assistant"])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in read_back(format_conversations(linear_tree(turns))).collect()}
    for c in range(10):
        own = [(r or "", t or "") for i, _, r, t in rows if i == c]
        assert [(t.role, t.text) for t in got[c].turns] == own
        assert got[c].loss_text == "".join(t for r, t in own if r == "assistant")
        assert got[c].formatted.count("<|im_start|>") == got[c].formatted.count("<|im_end|>") == 5


def test_edge_cases(spark):
    rows = [(None, 1, "user", "a", 1, "x"), (None, None, "user", "b", 1, "x"), (5, 1, "user", "same", 1, "x"), (5, 1, "user", "same", 1, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node_id int, path string")
    got = {r.conv_id: [t.text for t in r.turns] for r in read_back(format_conversations(linear_tree(turns))).collect()}
    assert got == {None: ["b", "a"], 5: ["same", "same"]}
    assert format_conversations(linear_tree(turns.limit(0))).count() == 0


def test_long_chain(spark):
    turns = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "cast(id AS string) AS text")
    r = read_back(format_conversations(linear_tree(turns))).first()
    assert [t.text for t in r.turns] == [str(i) for i in range(3000)]
