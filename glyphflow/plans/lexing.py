"""Chooses how a rule set is lexed: one alternation in the JVM where that gives the longest match, else Python.

One regex takes the first branch that matches, not the longest. That agrees with longest-match lexing when rules that
may start with the same character are literals among themselves, or a literal and a run of a class: longer literals
go first, and a literal that a run could carry on is kept only where it doesn't go on. Anything else is left to the
general lexer.
"""

from __future__ import annotations

from dataclasses import dataclass

from glyphflow.functions.unicode_tables import Ranges, merged
from glyphflow.rules import UNBOUNDED, CompiledRule, char_class


@dataclass(frozen=True)
class NativeLexer:
    pattern: str
    #: (literal, type, skippable), and (first characters, type, skippable) of the other rules, small sets first.
    literals: tuple[tuple[str, str, bool], ...]
    classes: tuple[tuple[Ranges, str, bool], ...]

    @property
    def rules(self) -> str:
        """The pattern without its last branch, which takes any one character that no rule does."""
        return self.pattern.removesuffix(_ANY).removesuffix("|") or "(?!)"


_ANY = r"[\s\S]"


def _overlap(a: Ranges, b: Ranges) -> bool:
    return any(x <= v and u <= y for x, y in a for u, v in b)


def _run(rule: CompiledRule) -> Ranges | None:
    """The characters by which a run goes on; None for a rule of another shape."""
    atoms = rule.atoms or ()
    if any(a.text is not None for a in atoms):
        return None
    if len(atoms) == 1 and atoms[0].least <= 1 and atoms[0].most >= UNBOUNDED:
        return atoms[0].chars
    if len(atoms) == 2 and (atoms[0].least, atoms[0].most) == (1, 1) and atoms[1].least == 0 and atoms[1].most >= UNBOUNDED:
        return atoms[1].chars
    return None


def native_lexer(rules: list[CompiledRule], contexts: tuple[str, ...] = ("default",)) -> NativeLexer | None:
    """A plan for the rules, or None where only the general lexer is right. Rules come by falling priority."""
    stack = set(contexts) | {"default"}
    usable = [r for r in rules if not r.error and (not r.context or r.context in stack)]
    if any(r.kind == "RegexNfa" for r in usable):
        return None
    kept: list[CompiledRule] = []
    for r in usable:
        if not any(k.pattern == r.pattern or (k.literal is not None and k.literal == r.literal and k.ignore_case == r.ignore_case) for k in kept):
            kept.append(r)
    if any(r.literal is not None and r.ignore_case for r in kept):
        return None
    stops: dict[int, list] = {}
    gone: set[int] = set()
    for i, a in enumerate(kept):
        for j in range(i + 1, len(kept)):
            b = kept[j]
            if not _overlap(a.first, b.first) or (a.literal is not None and b.literal is not None):
                continue
            if (a.literal is None) == (b.literal is None):
                return None
            lit, cls, lit_at = (a, b, i) if a.literal is not None else (b, a, j)
            onward = _run(cls)
            if onward is None:
                return None
            if cls.matcher()(lit.literal, 0) == len(lit.literal):
                if lit_at == i:
                    stops.setdefault(lit_at, []).extend(onward)  # wins the tie, but not where the run goes on
                else:
                    gone.add(lit_at)
    literals = sorted((i for i, r in enumerate(kept) if r.literal is not None and i not in gone), key=lambda i: -len(kept[i].literal))
    branches = [kept[i].java_regex + (f"(?!{char_class(merged(stops[i]))})" if i in stops else "") for i in literals]
    classes = [r for r in kept if r.literal is None]
    branches += [r.java_regex for r in classes]
    # The last branch takes any one character that no rule does; lexing stops there.
    return NativeLexer(
        "|".join([*branches, _ANY]),
        tuple((kept[i].literal, _type(kept[i]), kept[i].skippable) for i in literals),
        tuple((r.first, _type(r), r.skippable) for r in sorted(classes, key=lambda r: len(r.first))),
    )


def _type(rule: CompiledRule) -> str:
    from glyphflow.lexer import _RETURN

    return m[1] if (m := _RETURN.search(rule.action)) else rule.name
