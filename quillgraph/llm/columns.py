"""SQL for array expressions whose cost grows in proportion to the array."""

from __future__ import annotations

from itertools import count

#: Elements folded into one growing array; bounds what a step copies.
_BLOCK = 256
_numbers = count()


def bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running(values: str, combine: str) -> str:
    """The running totals of an array of bigint, from 0, each with its own element.

    ``combine``: the total {a} and the next element {b}.  A fold that appends to
    an array copies it at every step; so blocks are folded alone, then their
    totals, and no array that grows is long.
    """
    v, k, s, x, y = (f"{n}{next(_numbers)}" for n in ("v", "k", "s", "x", "y"))
    one = bound(combine.format(a=f"{s}.at", b=x), y, f"struct({y} AS at, concat({s}.out, array({y})) AS out)")
    block = f"aggregate(slice({v}, {k} * {_BLOCK} + 1, {_BLOCK}), struct(0L AS at, cast(array() AS array<bigint>) AS out), ({s}, {x}) -> {one}, {s} -> {s}.out)"
    many = bound(f"transform({x}, {y} -> {combine.format(a=f'{s}.at', b=y)})", f"{y}_", f"struct(element_at({y}_, -1) AS at, concat({s}.out, array({y}_)) AS out)")
    blocks = f"transform(sequence(0, int((size({v}) - 1) div {_BLOCK})), {k} -> {block})"
    whole = f"flatten(aggregate({blocks}, struct(0L AS at, cast(array() AS array<array<bigint>>) AS out), ({s}, {x}) -> {many}, {s} -> {s}.out))"
    return bound(values, v, f"if(size({v}) = 0, cast(array() AS array<bigint>), {whole})")
