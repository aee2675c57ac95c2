"""Words and characters that features look up, as a table of its own.

A lexicon is data: it is read from JSON by ``from_json`` and never from code.
``DEFAULT`` is one for English.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields


class LexiconError(ValueError):
    """A lexicon that lacks a field or holds something else than strings."""


@dataclass(frozen=True)
class Lexicon:
    """Character sets are strings of characters, word lists tuples; abbreviations end in a full stop."""

    primary: str
    secondary: str
    paragraph: str
    spaces: str
    punctuation: str
    opening_quotes: str
    closing_quotes: str
    abbreviations: tuple[str, ...]
    titles: tuple[str, ...]
    list_markers: tuple[str, ...]
    list_intros: tuple[str, ...]
    list_conjunctions: tuple[str, ...]

    @property
    def terminators(self) -> str:
        return self.primary + self.secondary

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Lexicon:
        """A lexicon from an object of its fields; missing, unknown and wrongly typed ones raise, as do abbreviations without a full stop."""
        raw = json.loads(text)
        kinds = {f.name: f.type for f in fields(Lexicon)}
        if not isinstance(raw, dict) or set(raw) != set(kinds):
            raise LexiconError(f"a lexicon has the fields {sorted(kinds)}")
        values = {}
        for name, kind in kinds.items():
            value = raw[name]
            if kind == "str" and isinstance(value, str):
                values[name] = value
            elif kind != "str" and isinstance(value, list) and all(isinstance(x, str) and x for x in value):
                values[name] = tuple(dict.fromkeys(value))
            else:
                raise LexiconError(f"{name} holds something else than text")
        if not all(a.endswith(".") for a in values["abbreviations"] + values["titles"]):
            raise LexiconError("abbreviations end in a full stop")
        return Lexicon(**values)


DEFAULT = Lexicon(
    primary=".!?…",
    secondary="\"')]}”’»",
    paragraph="\n\r",
    spaces=" \t\f\v",
    punctuation=",;:-–—/\\([{<>&%$#@*+=_~^|“‘«•",
    opening_quotes="\"'“‘«",
    closing_quotes="\"'”’»",
    titles=("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Rev.", "Hon.", "Sen.", "Rep.", "Gov.", "Gen.", "Col.", "Maj.", "Capt.", "Lt.", "Sgt.", "Fr.", "Sr.", "St.", "Mt.", "Ft.", "Messrs.", "Mme.", "Mlle.", "Pres.", "Supt.", "Cmdr.", "Adm."),
    abbreviations=(
        "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Rev.", "Hon.", "Sen.", "Rep.", "Gov.", "Gen.", "Col.", "Maj.", "Capt.", "Lt.", "Sgt.", "Fr.", "Sr.", "Jr.", "St.", "Mt.", "Ft.", "Messrs.", "Mme.", "Mlle.",
        "Pres.", "Supt.", "Cmdr.", "Adm.", "Inc.", "Ltd.", "Co.", "Corp.", "Bros.", "LLC.", "L.L.C.", "L.P.", "N.V.", "S.A.", "Assn.", "Dept.", "Univ.", "Ave.", "Blvd.", "Rd.", "Ln.", "Ct.", "Hwy.", "Pkwy.", "Sq.",
        "etc.", "vs.", "v.", "cf.", "Cf.", "e.g.", "i.e.", "E.g.", "I.e.", "viz.", "al.", "ibid.", "Ibid.", "id.", "op.", "cit.", "ca.", "approx.", "est.", "incl.", "resp.", "esp.", "max.", "min.", "no.", "No.", "nos.", "Nos.",
        "vol.", "Vol.", "vols.", "p.", "pp.", "ch.", "Ch.", "sec.", "Sec.", "art.", "Art.", "fig.", "Fig.", "figs.", "Figs.", "eq.", "Eq.", "ed.", "eds.", "trans.", "rev.", "par.", "para.", "cl.", "app.", "App.",
        "U.S.", "U.K.", "U.N.", "E.U.", "U.S.C.", "C.F.R.", "F.2d.", "D.C.", "N.Y.", "Cal.", "Mass.", "Ill.", "Tex.", "Fla.", "Pa.", "Va.", "Conn.", "a.m.", "p.m.", "A.M.", "P.M.", "A.D.", "B.C.", "Ph.D.", "M.D.", "B.A.", "M.A.", "J.D.",
        "Jan.", "Feb.", "Mar.", "Apr.", "Jun.", "Jul.", "Aug.", "Sep.", "Sept.", "Oct.", "Nov.", "Dec.", "Mon.", "Tue.", "Wed.", "Thu.", "Fri.", "Sat.", "Sun.", "ft.", "in.", "lb.", "lbs.", "oz.", "mi.", "hr.", "hrs.", "mins.", "tel.", "Tel.", "ext.",
    ),
    list_markers=("(a)", "(b)", "(c)", "(i)", "(ii)", "(iii)", "(1)", "(2)", "(3)", "1.", "2.", "3.", "•", "- "),
    list_intros=("following:", "as follows:", "including:", "include:", "includes:", "such as:", "namely:"),
    list_conjunctions=(" and", " or", " but"),
)
