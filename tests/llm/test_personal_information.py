import pytest

from mnemospark.llm import personal_information as pii

LEXICON = [("Isaura", "given"), ("Kelda", "given"), ("Mark", "given"), ("Grace", "given"), ("Purvanen", "family"), ("Zarek", "family"), ("厉", "family"), ("高", "family"), ("衍之", "given"), ("岫", "given")]

SENTENCES = [
    ("Call Ms ⟦name:Isaura Purvanen⟧ on ⟦phone:+1 607 555 0112⟧.", 12),
    ("Reach ⟦name:Kelda M. Zarek⟧ at ⟦email:kelda.z+x@mail.example⟧, then rest.", 12),
    ("Lunch with ⟦name:Purvanen, Isaura⟧ and ⟦name:Grace Zarek⟧.", 12),
    ("⟦name:Isaura Zarek⟧ lives at ⟦address:Flat 3B, 718 Ashgrove Close⟧, Tarnside.", 12),
    ("Parcels go to ⟦address:94 Sorrel Lane⟧.", 8),
    ("Tax id ⟦id_number:666-42-8863⟧ belongs to ⟦name:Kelda Purvanen⟧.", 12),
    ("Passport ⟦id_number:XZ9153959⟧ belongs to ⟦name:K. Zarek⟧.", 8),
    ("Text [⟦phone:(020) 7946 0827⟧] after lunch.", 8),
    ("Cc <⟦email:isaura.9 [at] mail [dot] example⟧> and ⟦email:grace@post.example.org⟧.", 8),
    ("联系人⟦name:厉衍之⟧电话⟦phone:182 0000 4618⟧，周末见。", 12),
    ("身份登记为（⟦id_number:998788198201115140⟧）由⟦name:高岫⟧核对。", 8),
    ("旧地址「⟦address:青屿市望溪区落星路765号17栋⟧」已停用。", 8),
    ("打⟦phone:１５４ ００００ ３０３４⟧找⟦name:厉岫⟧。", 8),
    ("Order 836843208073 left, ticket 4779-1994-14, build 14.14.1.30.", 12),
    ("Installed @draliasum/hulando@3.15.0 from git@nimstenon:korgithora.", 12),
    ("Mark the bicycle as done; grace period of 61 days.", 8),
    ("高兴地在石头路边粉刷果酱，离码头52公里的路口，订单886639352980119727。", 8),
]


def parse(marked):
    text, spans = "", []
    while marked:
        head, _, rest = marked.partition("⟦")
        text += head
        if not rest:
            break
        inside, _, marked = rest.partition("⟧")
        kind, _, body = inside.partition(":")
        spans.append((kind, len(text)))
        text += body
    return text, spans


@pytest.fixture(scope="module")
def corpus():
    rows, truth = [], set()
    for k, (marked, n) in enumerate(SENTENCES):
        for j in range(n):
            text, spans = parse(("Filler words come first. " if j % 2 else "") + marked)
            rows.append((f"s{k:02}-{j:02}", text, "x"))
            truth |= {(f"s{k:02}-{j:02}", kind, start) for kind, start in spans}
    return rows, truth


def frames(spark, rows):
    return spark.createDataFrame(rows, "row_id string, content string, pii_type string"), spark.createDataFrame([(i, p, k, "en") for i, (p, k) in enumerate(LEXICON)], "name_id long, name_part string, kind string, lang string")


def test_held_out_accuracy(spark, corpus):
    rows, truth = corpus
    got = {(r.row_id, r.pii_type, r.start_pos) for r in pii.find_spans(*frames(spark, rows)).collect()}
    right = len(got & truth)
    assert right / len(truth) >= 0.95, sorted(truth - got)[:10]
    assert right / len(got) >= 0.95, sorted(got - truth)[:10]


def test_redaction_keeps_the_rest(spark, corpus):
    rows, _ = corpus
    extra = [("null", None, "x"), ("empty", "", "x"), (None, "Call Ms Isaura Purvanen on +1 607 555 0112.", "x"), ("long", "plain words here. " * 20_000 + "Call Ms Isaura Purvanen on +1 607 555 0112.", "x")]
    out = {r.row_id: r.content for r in pii.redact(*frames(spark, rows + extra)).collect()}
    assert out["s00-00"] == "Call Ms [NAME] on [PHONE]."
    assert out["s09-00"] == "联系人[NAME]电话[PHONE]，周末见。"
    assert out["s13-00"] == "Order 836843208073 left, ticket 4779-1994-14, build 14.14.1.30."
    assert out["null"] is None and out["empty"] == "" and out["long"].endswith("Call Ms [NAME] on [PHONE].")


def test_empty_table(spark):
    assert pii.find_spans(*frames(spark, [])).count() == 0
    assert pii.redact(*frames(spark, [])).count() == 0


def test_expectation_maximisation_finds_the_reliable_labeler():
    import numpy as np

    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    good = np.where(rng.random(4000) < 0.95, truth, ~truth)
    fair = np.where(rng.random(4000) < 0.8, truth, ~truth)
    also = np.where(rng.random(4000) < 0.8, truth, ~truth)
    votes = np.stack([good, fair, also], axis=1) * 2 - 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, prior, table = pii.estimate_reliabilities(patterns, counts)
    assert abs(prior - 0.4) < 0.05 and table[0, 1, 2] > table[1, 1, 2] and table[0, 1, 2] > 0.9
    rng_features = np.where(truth[:, None], 7, 9)
    w = pii.train_classifier(votes, rng_features, np.ones(len(votes)), truth.astype(float))
    score = pii.classify(w, np.zeros((2, 3), dtype=int), np.array([[7], [9]]))
    assert score[0] > 0.7 > 0.3 > score[1]  # without votes the span's own features decide


def test_other_sentence_frames(spark, corpus):
    """Frames that no cue list names: the shapes, the gazetteer and the classifier carry them."""
    rows, _ = corpus
    told, truth = [], set()
    frames_of = ["Yesterday ⟦name:Isaura Zarek⟧ rang.", "Write ⟦email:kelda@post.example⟧ tonight.", "Her line, ⟦phone:+44 20 7946 0827⟧, is busy.", "We moved into ⟦address:12 Marsh Street⟧ in May.", "⟦id_number:666-42-8863⟧ was typed twice.", "⟦name:Grace Mark Purvanen⟧ came first."]
    for k, marked in enumerate(frames_of):
        text, spans = parse(marked)
        told.append((f"new{k}", text, "x"))
        truth |= {(f"new{k}", kind, start) for kind, start in spans}
    got = {(r.row_id, r.pii_type, r.start_pos) for r in pii.find_spans(*frames(spark, rows + told)).collect() if r.row_id.startswith("new")}
    assert len(got & truth) >= len(truth) - 1 and len(got - truth) <= 1, (truth - got, got - truth)
