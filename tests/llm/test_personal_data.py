import numpy as np

from corpusloom.llm.personal_data import masked, personal_spans, reliabilities

FILL = ["The parser reads the table twice.", "Main Branch and Release Train are frozen.", "Clone it with git@forge.example.org:a/b.git today.", "Order 2023023-773 is the fixture id.", "Upgrade to 10.28.22.1 or later.", "The Copper Queue adapter replaces it.", "Trace id 7c941110-a3f3-242a-e1de-e1c01ef4aa9f is in the log."]
NAMES = ["Liora Falkov", "Venmar Thorne", "Kelrin Östwick", "Sorana Veld", "Dagrin Morv"]


def texts():
    out = []
    for n in range(60):
        name, other = NAMES[n % 5], NAMES[(n + 2) % 5]
        out.append(f"Dear {name.split()[0]}, {FILL[n % 7]} Thanks to {other} for the patch. {FILL[(n + 3) % 7]} Call +44 20 7946 0{100 + n} before noon. national id {10000000 + n}X appears. Address: {n + 1} Quillwick Lane. Reach me at user{n}@mail.example.org if it fails.")
    return out


def test_spans_and_masking(spark):
    rows = [(n, t) for n, t in enumerate(texts())] + [(100, None), (101, ""), (None, "Dear Liora, hi"), (5, texts()[5]), (102, "plain words only")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, pii_type string")
    spans = personal_spans(df, "doc_id", "text")
    got = {(r["doc_id"], r["pii_type"], r["pii_text"]) for r in spans.collect()}
    want = set()
    for n in range(60):
        want |= {(n, "person", NAMES[n % 5].split()[0]), (n, "person", NAMES[(n + 2) % 5]), (n, "phone", f"+44 20 7946 0{100 + n}"), (n, "id_number", f"{10000000 + n}X"), (n, "address", f"{n + 1} Quillwick Lane"), (n, "email", f"user{n}@mail.example.org")}
    assert got == want
    out = {r["doc_id"]: r["text"] for r in masked(df, "doc_id", "text", spans).collect()}
    assert out[100] is None and out[101] == "" and out[102] == "plain words only"
    assert out[0] == f"Dear [PERSON], {FILL[0]} Thanks to [PERSON] for the patch. {FILL[3]} Call [PHONE] before noon. national id [ID_NUMBER] appears. Address: [ADDRESS]. Reach me at [EMAIL] if it fails."


def test_words_beyond_the_broadcast_are_joined(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    whole, few = ({tuple(r)[:5] for r in personal_spans(df, "doc_id", "text", words=n).collect()} for n in (1000, 12))
    assert whole == few and len(whole) == 360


def test_classifier_decides(spark, monkeypatch):
    """Candidates are wider than what is reported: whatever is accepted is the classifier's choice."""
    import corpusloom.llm.personal_data as module

    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    monkeypatch.setattr(module, "decide", lambda votes, features, weights: np.ones(len(votes)))
    assert personal_spans(df, "doc_id", "text").count() > 420
    monkeypatch.setattr(module, "decide", lambda votes, features, weights: np.zeros(len(votes)))
    assert personal_spans(df, "doc_id", "text").count() == 0


def test_no_documents(spark):
    assert personal_spans(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").collect() == []


def test_reliabilities_find_the_good_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.9, 0.8, 0.55, 0.9)], axis=1).astype(int)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, table = reliabilities(patterns, counts.astype(float))
    assert ((post[inverse.ravel()] > 0.5) == truth).mean() > 0.95
    assert table[0, 0, 2] > table[0, 3, 2]
