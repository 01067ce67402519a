"""Model parameters as a text file of ``name value`` lines."""

from __future__ import annotations

from ..operators.hmm import Model

#: Names in the file, and fields of the model.
NAMES = {
    "deletion-open": "open_deletion",
    "insertion-open": "open_insertion",
    "deletion-extend": "extend_deletion",
    "insertion-extend": "extend_insertion",
    "modification-rate": "modification",
}


def parse(text: str, base: Model | None = None) -> Model:
    """A model with the values given, in any order; ``#`` starts a comment. Unknown names, values out of 0-1 and openings above 1 in sum are refused."""
    values = dict(vars(base or Model()))
    for number, line in enumerate(text.splitlines(), 1):
        if len(line) > 255:
            raise ValueError(f"line {number} is too long")
        words = line.partition("#")[0].split()
        if not words:
            continue
        if len(words) != 2 or words[0] not in NAMES:
            raise ValueError(f"line {number}: not a parameter: {line.strip()}")
        value = float(words[1])
        if not 0 <= value <= 1:
            raise ValueError(f"line {number}: {words[0]} lies in 0-1")
        values[NAMES[words[0]]] = value
    return Model(**values)


def dump(model: Model) -> str:
    return "".join(f"{name:<18} {getattr(model, field):g}\n" for name, field in NAMES.items())
