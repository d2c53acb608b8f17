"""Known entities: names under which one thing is searched.  The table is a parameter; the default is a small example of ours."""

from __future__ import annotations

#: id -> labels, the canonical one first.
TABLE: dict[str, tuple[str, ...]] = {"apache-license": ("Apache License", "Apache-2.0", "ASL"), "mit-license": ("MIT License", "Expat License"), "united-nations": ("United Nations", "UN", "ONU", "Vereinte Nationen")}


def _key(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


def resolve(text: str, table: dict[str, tuple[str, ...]] | None = None) -> str | None:
    """The entity named by a text: an exact label counts 100, a label of which it is the only beginning 80; a tie at the top is none."""
    table = TABLE if table is None else table
    wanted = _key(text)
    if len(wanted) < 2:
        return None
    scores = {e: max(100 if _key(x) == wanted else 80 if len(wanted) >= 4 and _key(x).startswith(wanted) else 0 for x in labels) for e, labels in table.items()}
    top = max(scores.values(), default=0)
    best = [e for e, s in scores.items() if s == top and top > 0]
    return best[0] if len(best) == 1 else None


def labels(entity: str, table: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    return list((TABLE if table is None else table)[entity])


def segment(text: str, table: dict[str, tuple[str, ...]] | None = None) -> list[str] | None:
    """Entities of an unspaced text, the longest label first at each place; None if some part names none."""
    names = sorted(((_key(x), e) for e, ls in (TABLE if table is None else table).items() for x in ls), key=lambda p: -len(p[0]))
    rest, out = _key(text), []
    while rest:
        hit = next(((k, e) for k, e in names if rest.startswith(k)), None)
        if not hit:
            return None
        out.append(hit[1])
        rest = rest[len(hit[0]) :]
    return out or None
