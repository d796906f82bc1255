import random
import re

from helpers import empty, rows, table

from lodestone.llm import pii

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_force(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("ab1.29@+- ()0é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_force(t), t


def test_long_runs_are_linear():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "+1" * 100_000, "1." * 100_000, "@" * 100_000):
        pii.all_spans(t, pii.base_spans(t))


def test_disguises():
    cases = {
        "mail joe dot smith at mail dot example dot com now": "email:joe dot smith at mail dot example dot com",
        "x joe.smith (at) mail [dot] example (dot) com": "email:joe.smith (at) mail [dot] example (dot) com",
        "call plus one five five five one two three four five six seven ok": "phone:plus one five five five one two three four five six seven",
        "ip one nine two dot one six eight dot one dot one two end": "ip:one nine two dot one six eight dot one dot one two",
        "jоe@exаmple.cоm": "email:jоe@exаmple.cоm",
        "４１１１ １１１１ １１１１ １１１１": "card:４１１１ １１１１ １１１１ １１１１",
        "joe​@exa​mple.com": "email:joe​@exa​mple.com",
        "192[.]168[.]1[.]1": "ip:192[.]168[.]1[.]1",
    }
    for t, want in cases.items():
        spans = pii.all_spans(t, pii.base_spans(t))
        assert [f"{k}:{t[s:e]}" for k, s, e in spans] == [want], t
    for t in ("we met at noon. one two three four go", "look at that dot", "the dot at the end", "one at a time"):
        assert pii.all_spans(t, pii.base_spans(t)) == []


def test_base_spans_stay():
    t = "a@b.co and x (at) y (dot) org and +1 212 555 0100"
    base = pii.base_spans(t)
    assert set(base) < set(pii.all_spans(t, base))


def test_operator(spark):
    df = table(spark).selectExpr("doc_id", "text", "'mine' AS spans", "1 AS n_ip")
    out = pii.find_pii(df, redact=True).collect()
    assert len(out) == len(rows()) and all(r.redacted == r.text for r in out)
    assert pii.find_pii(empty(spark)).count() == 0
    one = pii.find_pii(spark.createDataFrame([("a@b.co +1 212 555 0100",)], "text string"), redact=True).first()
    assert (one.n_email, one.n_phone, one.redacted) == (1, 1, "[EMAIL] [PHONE]")


def test_every_disguise_of_the_grammar_is_tried():
    mails = ["jane{@}example.com", "jane ( @ ) example.com", "jane < at > example.com", "jane [  at  ] example.com", "jane@example{.}com", "jane@example (point) com", "jane at example\ndot\ncom", "jane\tat\texample\tdot\tcom"]
    others = {"192{.}168{.}0{.}1": "ip", "10 [ . ] 1 [ . ] 2 [ . ] 3": "ip", "plus 1 212 555 0100": "phone", "one two ſix plus 1 212 555 0100": None}
    for t, kind in [*((m, "email") for m in mails), *others.items()]:
        spans = pii.all_spans(t, pii.base_spans(t))
        assert kind is None or spans == [(kind, 0, len(t))], t


def test_gates_change_nothing():
    rng = random.Random(4)
    parts = ["jane", "example", "com", "at", "AT", "dot", "Dot", "point", "plus", "one", "Two", "ſix", "7", "10", "192", "@", ".", "[", "]", "(", ")", "{", "}", "<", ">", " ", "  ", "\t", "\n", "-", "+"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 14)))
        assert pii._phrases(t).edits == pii._phrases(t, gated=False).edits, t
