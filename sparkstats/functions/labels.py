"""Value labels (user formats) as native map / CASE expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Carrier code -> name (15 listed codes, anything else is 'Other').
CARRIER_NAMES = {
    "AA": "American Airlines", "AS": "Alaska Airlines", "B6": "JetBlue Airways",
    "DL": "Delta Air Lines", "F9": "Frontier Airlines", "G4": "Allegiant Air",
    "HA": "Hawaiian Airlines", "NK": "Spirit Airlines", "OH": "PSA Airlines",
    "OO": "SkyWest Airlines", "QX": "Horizon Air", "UA": "United Airlines",
    "WN": "Southwest Airlines", "YV": "Mesa Airlines", "YX": "Republic Airways",
}
# Month number -> abbreviation.
MONTH_NAMES = {1: "Jan", 2: "Feb", 3: "Mar", 4: "Apr", 5: "May", 6: "Jun",
               7: "Jul", 8: "Aug", 9: "Sep", 10: "Oct", 11: "Nov", 12: "Dec"}
# Cancellation code -> reason.
CANCEL_REASONS = {"A": "Carrier Issue", "B": "Weather", "C": "NAS / ATC",
                  "D": "Security", "N": "Not Cancelled"}
# ISO day of week (1 = Monday) -> name.
DAY_NAMES = {1: "Monday", 2: "Tuesday", 3: "Wednesday", 4: "Thursday",
             5: "Friday", 6: "Saturday", 7: "Sunday"}
# Flight status -> report label.
STATUS_LABELS = {"On Time": "On Time", "Minor": "Minor   (1–15 min)",
                 "Moderate": "Moderate (16–59 min)", "Severe": "Severe  (60+ min)",
                 "Cancelled": "Cancelled"}
# Delay severity bands [lower, upper) -> label; None = open end.
DELAY_BANDS = [(None, 0, "Early"), (0, 16, "On Time / Minor"), (16, 60, "Moderate"),
               (60, None, "Severe")]


def value_label(col, mapping: dict, default: str | None = None) -> Column:
    """Code -> label through a literal map; unknown codes get ``default``.

    A literal map stays inside codegen. For dictionaries of thousands of
    entries a broadcast join of a two-column table is the better plan.
    """
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    labelled = m[c]
    return F.coalesce(labelled, F.lit(default)) if default is not None else labelled


def range_label(col, bands=DELAY_BANDS) -> Column:
    """Half-open numeric bands -> label; null stays null (unlabelled)."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for lo, hi, label in bands:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (c >= lo)
        if hi is not None:
            cond = cond & (c < hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr
