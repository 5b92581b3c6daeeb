from selvage.llm import pii


def test_base_patterns_without_retries():
    spans = lambda t: [(pii.KINDS[k], t[a:b]) for a, b, k in pii.base_spans(t)]
    assert spans("x a.b@c.de.") == [("email", "a.b@c.de")]
    assert spans("a@b.c@d.e") == [("email", "a@b.c")]
    assert spans("1.2.3.4.5.6.7.300") == [("ip", "1.2.3.4")]
    assert spans("999.1.1.1") == []
    assert spans("4111 1111 1111 1111") == [("card", "4111 1111 1111 1111")]
    assert spans("4111 1111 1111 1112") == []
    assert spans("+1 (017) 555-7713 x") == [("phone", "+1 (017) 555-7713")]


def test_long_runs_take_linear_time():
    assert pii.find_spans("a" * 200_000 + "9" * 200_000 + "." * 200_000, pii.train())[1] == []


def test_field_finds_what_patterns_miss_and_leaves_other_numbers():
    field = pii.train()
    t = 'token = "0641917ea4e9feb9cda83477b57ac2654884f485" and some text'
    assert [t[a:b] for a, b, k in pii.find_spans(t, field)[1] if pii.KINDS[k] == "secret"] == ["0641917ea4e9feb9cda83477b57ac2654884f485"]
    for clean in ("on 2024-05-06 at 10:15 we sold 1,200 units", "version 1.20.3 of the year 1998", "words alone and nothing else"):
        assert pii.find_spans(clean, field) == ([], [])


def test_long_secrets_are_found_whole():
    import random

    rng, field = random.Random(4), pii.train()
    for n in (32, 40, 64, 96, 128, 256):
        for _ in range(20):
            secret = "".join(rng.choice("0123456789abcdef") for _ in range(n))
            t = f'some text token = "{secret}" and more'
            if pii.base_spans(t):  # a card number by chance: the base goes first
                continue
            assert [t[a:b] for a, b, k in pii.find_spans(t, field)[1] if pii.KINDS[k] == "secret"] == [secret]


def test_decoding_is_the_best_segmentation():
    """Against every segmentation of short windows."""
    import numpy as np

    field = pii.train()
    for t in ("call 555-201-4477 now", "x 10.0.0.1 y", "a@b.cd 12"):
        bounds, segments = pii.candidates(t, 0, len(t))
        n = len(bounds) - 1
        best = (-np.inf, None)

        def walk(at, after, score, spans):
            nonlocal best
            if at == n:
                best = max(best, (score, spans))
                return
            walk(at + 1, 0, score + field.moves[after, 0], spans)
            for i, j in segments:
                if i == at:
                    w = field.weights[pii.features(t, bounds[i], bounds[j])].sum(axis=0)
                    for k in range(len(pii.KINDS)):
                        walk(j, 1, score + field.moves[after, k + 1] + w[k], (*spans, (bounds[i], bounds[j], k)))

        walk(0, 0, 0.0, ())
        assert tuple(field.decode(t, 0, len(t))) == best[1]


def test_odd_rows(odd, none):
    assert pii.find(odd).count() == 11 and pii.find(none).count() == 0
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == 11
    assert pii.redact(none).count() == 0


def test_mask():
    assert pii.mask("ab cd ef", [(0, 2, 0), (1, 4, 1), (6, 8, 3)]) == "<email>d <phone>"
    assert pii.mask(None, []) is None
