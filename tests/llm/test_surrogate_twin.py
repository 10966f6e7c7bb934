"""Personal data against a twin in plain Python: the same entities, draws and texts, also where surrogates are scarce."""

import hashlib
import string

import regex

from heliograph.llm import surrogates as s

WORD = r"\p{L}\p{N}"
EMAIL = rf"(?<![{WORD}._%+-])[{WORD}._%+-]{{1,64}}@[{WORD}-]{{1,63}}(?:\.[{WORD}-]{{1,63}})+"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
SSN = "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9+])\([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])"
KEYED = r"(?<![\p{L}\p{N}_])token=[^\s\"']{8,}"
ENTITY = regex.compile(f"(?P<email>{EMAIL})|(?P<ip>{IP})|(?P<ssn>{SSN})|(?P<phone>{PHONE})|(?P<secret>{KEYED})")


def hexes(kind, norm, draw):
    return hashlib.sha256(f"{s.KEY}|{kind}|{norm}|{draw}".encode()).hexdigest()


def number(h, i):
    return int(h[2 * (i % 32) : 2 * (i % 32) + 2], 16) + i // 32 * 7


def like(v, h, letters):
    out = ""
    for i, c in enumerate(v):
        n = number(h, i)
        out += str(n % 10) if c in string.digits else string.ascii_lowercase[n % letters] if c in string.ascii_lowercase else string.ascii_uppercase[n % letters] if c in string.ascii_uppercase else c
    return out


def longer(v, draw, free):
    last = next((c for c in reversed(v) if c.isalnum()), "x")
    return v + last * max(0, draw - free)


def is_hex(v):
    return 6 if regex.fullmatch("[0-9a-f]+", v) else 26


def draw_of(kind, norm, draw):
    h = hexes(kind, norm, draw)
    if kind == "mailbox":
        user, host = norm.split("@")
        return f"{like(longer(user, draw, 0), h, 26)}@@{host}"
    if kind == "host":
        return f"{h[: draw + 8]}.example.org"
    if kind == "ip":
        return ".".join([str(number(h, 3)) if draw else "10", *(str(number(h, i)) for i in range(3))])
    v = norm if kind == "ssn" else longer(norm, draw, s.FORMED_DRAWS)
    return like(v, h, is_hex(v))


def forms(kind, v):
    if kind == "email":
        return [("mailbox", v.lower()), ("host", v.lower().split("@")[1])]
    return [(kind, {"ip": v, "secret": regex.sub(f"[^{WORD}]*$", "", v[6:])}.get(kind, "".join(filter(str.isdigit, v))))]


def settled(found):
    """The draw of every form, by the stated rule: clashes and others' real values are drawn for again."""
    state = {f: 0 for kind, v in found for f in forms(kind, v)}
    for rounds in range(s.MOST_DRAWS):
        made, real = {}, {(k, n.lower()) for k, n in state}
        for (kind, norm), draw in sorted(state.items(), key=lambda x: (x[1], x[0][1])):
            made.setdefault((kind, draw_of(kind, norm, draw).lower()), []).append((kind, norm))
        again = {f for place, own in made.items() for f in (own if place in real else own[1:])}
        if not again:
            return state, rounds
        state = {f: d + (f in again) for f, d in state.items()}
    raise AssertionError("not settled")


def replaced(text, state):
    def one(m):
        kind, v = m.lastgroup, m[0]
        new = [draw_of(k, n, state[k, n]) for k, n in forms(kind, v)]
        if kind == "email":
            return f"{new[0].split('@@')[0]}@{new[1]}"
        if kind == "secret":
            return f"token={new[0]}{v[6 + len(forms(kind, v)[0][1]) :]}"
        if kind == "ip":
            return new[0]
        digits = iter(new[0])
        return "".join(next(digits) if c.isdigit() else c for c in v) + "".join(digits)

    return ENTITY.sub(one, text)


def one_sign():
    return [f"{c}@corp.com" for c in string.ascii_lowercase + string.digits]


def two_signs():
    return [f"{a}{b}@corp.com" for a in string.ascii_lowercase + string.digits for b in string.ascii_lowercase + string.digits]


CASES = {
    "one sign": one_sign(),
    "two signs": two_signs(),
    "hexadecimal": [f"{c}@corp.com" for c in "abcdef0123456789"] + ["_@corp.com", ".@corp.com"],
    "three digits": [f"{k:03}@corp.com" for k in range(1000)],
    "scarce secrets": [f"token=********{k}" for k in range(10)],
    "scarce addresses of others": [f"{k}@h{k % 7}.org, 10.{k}.2.3; ({k % 900 + 100}) 555-{k:04} and 900-{k % 100:02}-{k:04}." for k in range(200)],
}


def test_texts_are_those_of_the_twin(spark):
    """All cases in one table, since entities are told apart over all documents."""
    texts = [t for case in CASES.values() for t in case]
    found = sorted({(m.lastgroup, m[0]) for t in texts for m in ENTITY.finditer(t)})
    state, rounds = settled(found)
    assert rounds <= 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in s.replace_personal_data(docs).collect()}
    assert got == {k: replaced(t, state) for k, t in enumerate(texts)}
    new = {(m.lastgroup, m[0]) for t in got.values() for m in ENTITY.finditer(t)}
    assert len(new) == len(found) and not new & set(found)


def test_hosts_are_never_merged(spark, monkeypatch):
    """With a single hex digit for a host, sixteen and more hosts still get surrogates of their own."""
    short = s.drawn_from

    def cut(kind, norm, hexes, draw, key):
        return s.F.when(kind == "host", s.F.concat(s.F.substring(hexes, s.F.lit(1), draw + 1), s.F.lit(".example.org"))).otherwise(short(kind, norm, hexes, draw, key))

    monkeypatch.setattr(s, "drawn_from", cut)
    docs = spark.createDataFrame([(k, f"me@host{k}.com") for k in range(40)], "doc_id long, text string")
    hosts = {r.text.split("@")[1] for r in s.replace_personal_data(docs).collect()}
    assert len(hosts) == 40 and all(h.endswith(".example.org") for h in hosts)
