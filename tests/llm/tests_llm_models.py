"""Plain-Python models that several tests use."""

from test_decontam import model as decontaminated
from test_line_dedup import L, near
from test_minhash import model as components


def line_model(texts):
    at = []
    for i, t in texts.items():
        at += [(i, p, x.strip(" \t\r\x0b\x0c").split(" ")) for p, x in enumerate(t.split("\n"))]
    at = [(i, p, w) for i, p, w in at if len(w) >= L.MIN_WORDS]
    gone = {(i, p) for i, p, w in at if any((j, q) < (i, p) and near(w, v) for j, q, v in at)}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in texts.items()}


def near_model(texts):
    kept = {i for i, _, _, k in components(list(texts.items())) if k}
    return {i: t for i, t in texts.items() if i in kept}


def decontam_model(text, items):
    return decontaminated(text, items)[4]
