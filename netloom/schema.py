"""Table layouts, coded values and the dataset container."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column lists of the seven network tables, in file order. (fixed values)
COLUMNS: dict[str, list[tuple[str, str]]] = {
    "companies": [
        ("company_cd", "bigint"), ("rr_cd", "bigint"), ("company_name", "string"),
        ("company_name_k", "string"), ("company_name_h", "string"),
        ("company_name_r", "string"), ("company_name_en", "string"),
        ("company_name_full_en", "string"), ("company_url", "string"),
        ("company_type", "int"), ("e_status", "int"), ("e_sort", "bigint"),
    ],
    "lines": [
        ("line_cd", "bigint"), ("company_cd", "bigint"), ("line_name", "string"),
        ("line_name_k", "string"), ("line_name_h", "string"), ("line_name_r", "string"),
        ("line_name_rn", "string"), ("line_name_zh", "string"), ("line_name_ko", "string"),
        ("line_color_c", "string"), ("line_type", "int"),
        ("line_symbol1", "string"), ("line_symbol2", "string"),
        ("line_symbol3", "string"), ("line_symbol4", "string"),
        ("line_symbol1_color", "string"), ("line_symbol2_color", "string"),
        ("line_symbol3_color", "string"), ("line_symbol4_color", "string"),
        ("line_symbol1_shape", "string"), ("line_symbol2_shape", "string"),
        ("line_symbol3_shape", "string"), ("line_symbol4_shape", "string"),
        ("e_status", "int"), ("e_sort", "bigint"), ("average_distance", "double"),
        ("transport_type", "int"),
    ],
    "stations": [
        ("station_cd", "bigint"), ("station_g_cd", "bigint"), ("station_name", "string"),
        ("station_name_k", "string"), ("station_name_r", "string"),
        ("station_name_rn", "string"), ("station_name_zh", "string"),
        ("station_name_ko", "string"), ("station_number1", "string"),
        ("station_number2", "string"), ("station_number3", "string"),
        ("station_number4", "string"), ("three_letter_code", "string"),
        ("line_cd", "bigint"), ("pref_cd", "int"), ("post", "string"),
        ("address", "string"), ("lon", "double"), ("lat", "double"),
        ("open_ymd", "string"), ("close_ymd", "string"), ("e_status", "int"),
        ("e_sort", "bigint"), ("transport_type", "int"),
    ],
    "types": [
        ("id", "bigint"), ("type_cd", "bigint"), ("type_name", "string"),
        ("type_name_k", "string"), ("type_name_r", "string"), ("type_name_zh", "string"),
        ("type_name_ko", "string"), ("color", "string"), ("direction", "int"),
        ("kind", "int"), ("priority", "int"),
    ],
    "station_station_types": [
        ("id", "bigint"), ("station_cd", "bigint"), ("type_cd", "bigint"),
        ("line_group_cd", "bigint"), ("pass", "int"),
    ],
    "aliases": [
        ("id", "bigint"), ("line_name", "string"), ("line_name_k", "string"),
        ("line_name_h", "string"), ("line_name_r", "string"), ("line_name_zh", "string"),
        ("line_name_ko", "string"), ("line_color_c", "string"),
    ],
    "line_aliases": [("id", "bigint"), ("station_cd", "bigint"), ("alias_cd", "bigint")],
}

# Integer key each table is written by. (fixed values)
KEYS = {
    "companies": "company_cd", "lines": "line_cd", "stations": "station_cd",
    "types": "id", "station_station_types": "id", "aliases": "id", "line_aliases": "id",
}

# The seven columns an alias may override on a line. (fixed values)
ALIAS_COLUMNS = [
    "line_name", "line_name_k", "line_name_h", "line_name_r",
    "line_name_zh", "line_name_ko", "line_color_c",
]

# Coded values with the label used when a code is unknown. (fixed values)
ENUMS: dict[str, tuple[dict[int, str], str]] = {
    "OperationStatus": ({0: "InOperation", 1: "NotOpened", 2: "Closed"}, "InOperation"),
    "TransportType": (
        {0: "TransportTypeUnspecified", 1: "Rail", 2: "Bus", 3: "RailAndBus"},
        "TransportTypeUnspecified"),
    "TtsAlphabet": (
        {0: "TtsAlphabetUnspecified", 1: "Ipa", 2: "Yomigana", 3: "Plain"},
        "TtsAlphabetUnspecified"),
    "StopCondition": (
        {0: "All", 1: "Not", 2: "Partial", 3: "Weekday", 4: "Holiday", 5: "PartialStop"}, "All"),
    "TrainDirection": ({0: "Both", 1: "Inbound", 2: "Outbound"}, "Both"),
    "TrainTypeKind": (
        {0: "Default", 1: "Branch", 2: "Rapid", 3: "Express", 4: "LimitedExpress",
         5: "HighSpeedRapid", 6: "CommuterRapid", 7: "BusRoute"}, "Default"),
    "LineType": (
        {0: "OtherLineType", 1: "BulletTrain", 2: "Normal", 3: "Subway", 4: "Tram",
         5: "MonorailOrAGT"}, "OtherLineType"),
    "CompanyType": (
        {0: "OtherCompany", 1: "JR", 2: "Private", 3: "Major", 4: "SemiMajor"}, "OtherCompany"),
}

RAIL, BUS = 0, 1


def decode_enum(code: Column, enum: str) -> Column:
    """Label of a coded value; unknown or missing codes take the enum's default."""
    labels, default = ENUMS[enum]
    out = None
    for value, label in labels.items():
        cond = code == F.lit(value)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


@dataclass(frozen=True)
class Network:
    """The seven tables as one unit, with measured bounds on group sizes.

    ``bounds`` holds the longest pattern, the busiest line and similar maxima
    (see ``operators.common.measure_bounds``); sequence operators use it to
    decide between one window per group and chunked windows.
    """

    companies: DataFrame
    lines: DataFrame
    stations: DataFrame
    types: DataFrame
    station_station_types: DataFrame
    aliases: DataFrame
    line_aliases: DataFrame
    bounds: dict[str, int] | None = None
    #: The cell tree of the stations (``operators.spatial.with_tree``); nearest joins build one where it is missing.
    tree: object | None = None
    #: Name indexes by table (``operators.lookup.with_names``); searches build one where they are missing.
    names: dict | None = None

    @property
    def sst(self) -> DataFrame:
        return self.station_station_types

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in COLUMNS}

    def with_tables(self, **changes) -> "Network":
        return replace(self, **changes)

    def bound(self, name: str) -> int | None:
        return None if self.bounds is None else self.bounds.get(name)


class DeferredNetwork(Network):
    """A network whose tables, bounds and indexes are made at first use and then kept.

    ``makers`` has a function of the network for each field, and one for each bound under ``bound:`` and its name.  A job pays
    for what it reads and for nothing else.
    """

    def __init__(self, makers: dict[str, Callable[[Network], object]], parent: DeferredNetwork | None = None, **made) -> None:
        self.__dict__.update(_makers=makers, _parent=parent, _made=made)

    def _get(self, name: str):
        if name not in self._made:
            self._made[name] = self._parent._get(name) if self._parent is not None else \
                self._makers[name](self) if name in self._makers else None
        return self._made[name]

    def with_tables(self, **changes) -> Network:
        return DeferredNetwork(self._makers, self, **changes)

    def bound(self, name: str) -> int | None:
        node = self
        while node is not None:
            if "bounds" in node._made:
                return None if node._made["bounds"] is None else node._made["bounds"].get(name)
            node = node._parent
        return self._get(f"bound:{name}")


for _field in fields(Network):
    setattr(DeferredNetwork, _field.name, property(lambda self, name=_field.name: self._get(name)))
