import random
import time

from skein.llm import pii


def found(text, disguised=True):
    return [(k, text[s:e]) for k, s, e, d in pii.find_spans(text) if d == disguised]


def test_disguised_spans_with_a_plain_part():
    for text, kind, plain in (
        ("jоhn.smith@example.com", "email", "hn.smith@example.com"),
        ("john@mail.example (dot) com", "email", "john@mail.example"),
        ("10.20.30.4５", "ip", "10.20.30.4"),
        ("+1 555 123 4567８", "phone", "+1 555 123 4567"),
    ):
        assert found(f"at {text}, now") == [(kind, text)], text
        assert found(f"at {text}, now", False) == [(kind, plain)], text
    assert found("write to john@example.com") == []


def test_spelled_runs_of_any_length():
    for text, kind in (
        ("one nine two dot one six eight dot one dot two", "ip"),
        ("+1 (five five five) one two three - four five six seven", "phone"),
        ("plus vier neun drei null eins zwei drei vier fünf sechs", "phone"),
        ("plus trois trois un deux trois quatre cinq six sept huit", "phone"),
        ("vier eins eins eins - eins eins eins eins - eins eins eins eins - eins eins eins eins", None),
    ):
        assert found(f"see {text}.") == ([(kind, text)] if kind else []), text
    for text in ("192.168.ſix.fİve", "192.168.one.7 one two threefold"):
        assert [k for k, _ in found(text)] == ["ip"], text
    for clean in ("one of the two, at least", "un deux trois", "sieben Zwerge und neun Wünsche", "null and void"):
        assert pii.find_spans(clean) == []


def test_a_marked_dot_counts_for_a_bare_at():
    for text in ("john at example (dot) com", "john at example[dot]com"):
        assert found(f"write {text} now") == [("email", text)], text
    assert pii.find_spans("meet at example.com") == []


#: By kind, ways to write one: {0} and {1} are replaced by random names or digits.
DISGUISES = {
    "email": (
        lambda d, n: f"{n} (at) mail{d}.example (dot) com", lambda d, n: f"{n} [at] example [dot] org", lambda d, n: f"{n} at example dot net", lambda d, n: f"{n} arroba ejemplo punto es",
        lambda d, n: f"{n.replace('a', 'а').replace('o', 'о')}@example.com", lambda d, n: f"{n}＠example．com", lambda d, n: f"{n}​@exam​ple.com", lambda d, n: f"{n} at beispiel punkt de",
        lambda d, n: f"{n * 12} at {n * 9} dot org",
    ),
    "ip": (lambda d, n: "192 dot 168 dot 4 dot 17", lambda d, n: "10[.]20[.]30[.]40", lambda d, n: "one nine two dot one six eight dot one dot two", lambda d, n: "１９２.１６８.１.９", lambda d, n: "eins null punkt drei punkt vier punkt fünf"),
    "card": (lambda d, n: "four" + " one" * 15, lambda d, n: "４１１１ １１１１ １１１１ １１１１", lambda d, n: "vier" + " eins" * 15, lambda d, n: "quatre" + " un" * 15, lambda d, n: "cuatro" + " uno" * 15),
    "phone": (
        lambda d, n: "plus one six one nine five five five one two three four", lambda d, n: "＋１ ６１９ ５５５ １２３４", lambda d, n: "plus vier neun drei null eins zwei drei vier fünf", lambda d, n: "+1 (five five five) one two three - four five six seven",
        lambda d, n: "plus trois trois un deux trois quatre cinq six sept",
    ),
}


def test_planted_disguises_are_found_by_kind():
    dice, fill = random.Random(5), "words before and after it , un deux pages at noon. "
    for kind, ways in DISGUISES.items():
        hits = trials = 0
        for way in ways:
            for _ in range(20):
                name = "".join(dice.choice("abeiklmnor") for _ in range(8)) + "a"
                planted = way(dice.randint(1, 9), name).strip()
                text = fill * dice.randint(1, 4) + "» " + planted + " « " + fill
                start, end = text.index(planted), text.index(planted) + len(planted)
                trials += 1
                hits += any(k == kind and s <= start + 1 and e >= end - 1 and s >= start - 1 and e <= end + 1 for k, s, e, _ in pii.find_spans(text))
        assert hits / trials >= 0.9, (kind, hits, trials)


def test_many_spans_take_linear_time():
    text = " ".join(f"u{i}@e.com" for i in range(12_000)) + " a at b dot com"
    began = time.perf_counter()
    assert len(pii.find_spans(text)) == 12_001
    assert time.perf_counter() - began < 2


def test_texts_left_alone_are_those_that_rewriting_would_not_change():
    """Against rewriting every text."""
    dice = random.Random(6)
    parts = ["one", "un", "vier", "7", "12", " ", ", ", "-", " dot ", ".", "(.)", "plus ", "+", "@", " at ", "x", "exam", "ｏ", "(", ")", "  ", "ı", "SıX"]
    for _ in range(20_000):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(1, 24)))
        if not pii.is_disguised(text):
            new = pii.Rewritten(text)
            new.look_alikes()
            new.spelled_digits()
            new.at_and_dot()
            plain = pii.plain_spans(text)
            for kind, start, end in pii.plain_spans(new.text):
                s, e = new.starts[start], new.ends[end - 1]
                assert text[s:e] == new.text[start:end] or any(a <= s and e <= b for _, a, b in plain), (text, kind, s, e)
