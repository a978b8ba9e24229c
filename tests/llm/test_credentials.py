import time

from corpusloom.llm.credentials import find_credentials, segmenter_of

SEG = segmenter_of({"solid": 5.0})
VALUE = "Khjd2fov132ZJTQog4tVDQE3"


def _values(text):
    return [text[s:e] for s, e in find_credentials(text, SEG)]


def test_long_lines_are_searched_whole():
    pad = "f(1);" * 1200
    for text in (f"token_x=f();{'g(22);' * 97}password='{VALUE}';", f"token='{VALUE * 40}';", f"// a: bcdefgh\tapi_key='{VALUE}'"):
        assert _values(text) and _values(pad + text) == _values(text) == _values(text + pad), text[:50]


def test_names_from_the_lists_open_a_line():
    for name in ("deploy_key", "licenseKey", "STORAGE_KEY", "storage_schluessel", "log_in", "pass-phrase", "mdp"):
        assert _values(f"{name} = '{VALUE}'") == [VALUE], name


def test_long_lines_take_linear_time():
    began = time.time()
    for unit in ("a1b2", "a.b-", " ", "//x", "x='", "x: a, ", "a = b || "):
        find_credentials("password " + unit * 50_000, SEG)
    assert time.time() - began < 20


def test_words_beyond_the_broadcast_are_joined(spark):
    from corpusloom.llm.credentials import credentials, redacted, word_costs

    names = spark.createDataFrame([(f"{a}_{b}",) for a in ("solid", "lantern", "harbor", "quiet", "meadow") for b in ("reader", "writer", "ledger")] * 3 + [(None,)], "name string")
    lines = [f"password = '{VALUE}'", "password = 'solidlanternmeadowledger9'", "# token: quietreaderxk7q9zz", "api_key = 'x'", "token = 'harborwriter42!'", f"a = 'postgres://u:{VALUE}@h/x'", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(0, lines[0]), (None, lines[0]), (50, "\n".join(t or "" for t in lines))], "id long, text string")
    whole, few = word_costs(names, "name"), word_costs(names, "name", most=2)
    assert whole.rest is None and few.rest is not None and len(few.costs) == 2 and {**few.costs, **{r["w"]: r["cost"] for r in few.rest.collect()}}.keys() == whole.costs.keys()
    a, b = ({tuple(r) for r in credentials(rows, "id", "text", w).collect()} for w in (whole, few))
    assert a == b and {(0, 1), (50, 1)} <= {(r[0], r[1]) for r in a} and not any(r[0] in (1, 3, 6, 7) for r in a)
    a, b = ({tuple(r) for r in redacted(rows, "id", "text", w).collect()} for w in (whole, few))
    assert a == b and (0, "password = 'REDACTED'", 1) in a
