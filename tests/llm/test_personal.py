import hashlib
import random
import re
import time

import pytest

from tarn.llm import personal as P


def plain(text):
    """kind:start:end of the plain forms, straight from their definitions."""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(d[::-1])]
        return sum(sum(map(int, str(x))) for x in doubled) % 10 == 0

    rows = [(m.start(), 0, m.end()) for m in email.finditer(text)]
    rows += [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    rows += [(m.start(), 2, m.end()) for m in card.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    rows += [(m.start(), 3, m.end()) for m in phone.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in sorted(rows))


def run(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in enumerate(texts)], "doc_id long, text string, base int, spans string").repartition(3)
    return {r["id"]: r for r in P.personal_data(df).collect()}


PIECES = ["a", "Z9", "@", ".", "-", "+", " ", "1", "25", "300", "0", "4845168114407329", "(", ")", "x.y@m-1.c", "+1 (017) 555-7713", "1.2.3.4", "\n", "é", "%", "_", "٣", "4845-1681 1440 7329", ". ."]


def test_plain_forms_are_those_of_the_definitions(spark):
    r = random.Random(3)
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 30))) for _ in range(600)] + [None, ""]
    got = run(spark, texts)
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        assert got[i]["base"] == plain(t or ""), t
        kinds = [x.split(":")[0] for x in got[i]["base"].split(",")]
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [kinds.count(k) for k in P.KINDS]
        assert set(got[i]["base"].split(",")) <= set(got[i]["spans"].split(","))


DISGUISED = {
    "email": [
        "und.34 (at) mail7 (dot) example (dot) com", "und.34 [at] mail7.example.com", "und.34{at}mail7{dot}example{dot}com", "und dot 34 at mail7 dot example dot com", "und.34 AT mail7 DOT example DOT com", "und.34[@]mail7[.]example[.]com",
        "und.34＠mail7．example．com", "und.34&#64;mail7&#46;example.com", "und.34%40mail7.example.com", "und.34 arroba mail7 punto example punto com", "und_at_mail7_dot_example_dot_com", "und.34 @ mail7 . example . com", "und.34 at mail7.example.com",
        "ѕales (at) mail7.example.com",
    ],
    "ip": ["97[.]51[.]17[.]173", "97 dot 51 dot 17 dot 173", "nine seven dot five one dot one seven dot one seven three", "９７.５１.17.173", "97(dot)51.17(dot)173", "eight dot eight dot eight dot eight"],
    "card": ["four eight four five one six eight one one four four zero seven three two nine", "4845 1681 one four four oh 7329", "４８４５１６８１１４４０７３２９", "4845-l681-l44O-7329", "vier acht vier fünf eins sechs acht eins eins vier vier null sieben drei zwei neun", "4845 1681 1440 7329"],
    "phone": ["plus one zero one seven five five five seven seven one three", "+1 (zero one seven) five five five-7713", "＋1 (017) 555‑7713", "plus 1 017 555 7713"],
}


@pytest.mark.parametrize("kind", P.KINDS)
def test_disguises_are_found_where_they_stand(spark, kind):
    frames = ["{}", "Écrivez à: {} !", "The thing (it is) {}\nand more of it.", "ﬁrst ½ {}, then"]
    texts = [f.format(d) for d in DISGUISED[kind] for f in frames]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        d = DISGUISED[kind][i // len(frames)]
        assert got[i]["base"] == "" and got[i]["spans"] == f"{kind}:{t.index(d)}:{t.index(d) + len(d)}", t


PROSE = [
    "See it at example.com, at some point in time, or working at the dot com boom.", "Une et un, plus 100 000 000 euros en 2019. Un et deux.", "We have two or three dots at home . Then we go @ noon.", "Version 3.5.2, chapter 4.5.6.", "one two three, four",
    "call me at 5 . One of us", "Mail is a@b, not more; l0 and O2 are names.", "Le point. Un point de vue at point blank", "+1 (848) 555-1373 Un étion", "4845168114407329 one and 97.51.17.173 two.",
]


def test_prose_is_left_alone(spark):
    got = run(spark, PROSE)
    assert all(r["base"] == r["spans"] for r in got.values())


def test_a_span_that_holds_a_plain_one(spark):
    t = "x und.34@mail7.example[.]com y"
    assert run(spark, [t])[0]["spans"] == f"email:2:22,email:2:{len(t) - 2}"
    t = "сof.55@mail.example.com"  # the first letter is another script's
    assert run(spark, [t])[0]["spans"] == f"email:0:{len(t)},email:1:{len(t)}"


@pytest.mark.parametrize("piece", ["1", "a", "@", "a@", "one ", "( at ", "1.", "&", "+1 ", " ", "|", "Ol1", "at ", "<", " dot a at b", "plus 1 ", "_at_", "&a", "."])
def test_time_grows_with_the_text(piece):
    def took(n):
        text, at = (piece * (n // len(piece))), time.process_time()
        P.spans_of("+1" + text)
        return time.process_time() - at

    took(10_000)
    assert took(800_000) < 40 * max(min(took(100_000), took(100_000)), 0.02)


def test_odd_tables_and_masks(spark):
    df = spark.createDataFrame([(None, "a@b.cc", 1), (5, "1.2.3.4", 1), (5, "1.2.3.4", 2), (6, None, 3)], "doc_id long, text string, id int")
    got = sorted((str(r["id"]), r["spans"]) for r in P.personal_data(df).collect())
    assert got == [("5", "ip:0:7"), ("5", "ip:0:7"), ("6", ""), ("None", "email:0:6")]
    assert P.personal_data(df.where("false")).count() == 0
    docs = spark.createDataFrame([(1, "to x (at) m.cc and +1 (017) 555-7713!"), (2, None), (3, "none")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in P.masked(docs, P.personal_data(docs)).collect()}
    assert out == {1: "to [email] and [phone]!", 2: None, 3: "none"}


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.cc 1.2.3.4")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = P.op13_personal_data(spark, str(tmp_path)).first()
    assert r["base_sha256"] == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest() and r["spans"] == "email:0:6,ip:7:14"
