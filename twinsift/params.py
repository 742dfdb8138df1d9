"""Search and index parameters; declared ranges are enforced."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

TYPES = {"image": 1, "video": 2, "audio": 4}
FLIPS = {"h": 1, "v": 2, "b": 4}
ALGOS = {"dct": 0, "fdct": 1, "orb": 2, "color": 3, "video": 4}


def parse_flags(value: int | str, names: dict[str, int]) -> int:
    """A number, or names joined by ``+``."""
    if isinstance(value, int):
        return value
    if value.isdigit():
        return int(value)
    out = 0
    for name in value.split("+"):
        if name not in names:
            raise ValueError(f"unknown flag: {name}")
        out |= names[name]
    return out


def _ranged(default: int, low: int, high: int):
    return field(default=default, metadata={"low": low, "high": high})


class _Checked:
    def __post_init__(self) -> None:
        for f in fields(self):
            low, high = f.metadata.get("low"), f.metadata.get("high")
            value = getattr(self, f.name)
            if low is not None and not low <= value <= high:
                raise ValueError(f"{f.name} must be {low} to {high}, not {value}")


@dataclass(frozen=True)
class SearchParams(_Checked):
    alg: str = "dct"
    dht: int = _ranged(5, 0, 65)
    odt: int = _ranged(25, 0, 256)
    vradix: int = _ranged(10, 0, 32)
    vfm: int = _ranged(30, 1, 1_000_000)
    vfn: int = _ranged(60, 1, 100)
    vtrim: int = _ranged(300, 0, 1_000_000)
    mn: int = _ranged(1, 1, 1_000_000)
    mm: int = _ranged(5, 1, 1_000_000)
    mt: int = _ranged(0, 0, 256)
    refl: int | str = 0
    tm: bool = False
    tdht: int = _ranged(7, 0, 65)
    fs: bool = True
    neg: bool = False
    fp: bool = False
    fg: bool = True
    path: str = ""
    in_path: bool = False
    mg: bool = False
    eg: bool = False
    types: int | None = None

    def flips(self) -> list[str]:
        """Names of the reflections of a needle to search for as well."""
        mask = parse_flags(self.refl, FLIPS)
        if not 0 <= mask < 8:
            raise ValueError(f"refl must be 0 to 7, not {mask}")
        return [{"b": "both"}.get(name, name) for name, bit in FLIPS.items() if mask & bit]

    def result_types(self) -> int:
        """Video searches look in images and videos unless types are given; others in images."""
        if self.types is not None:
            return self.types
        return TYPES["image"] | TYPES["video"] if self.alg == "video" else TYPES["image"]


@dataclass(frozen=True)
class IndexParams(_Checked):
    algos: int = _ranged(31, 0, 31)
    types: int = _ranged(7, 0, 7)
    fsize: int = _ranged(1024, 0, 1 << 40)
    nfeat: int = _ranged(400, 1, 100_000)
    rsize: int = _ranged(400, 32, 100_000)
    vht: int = _ranged(8, 0, 65)
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
