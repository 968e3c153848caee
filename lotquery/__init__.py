"""lotquery: parking-operations analytics as Spark DataFrame operators.

Every operator is a plain function from DataFrames (and explicit parameters,
including an explicit ``as_of`` time) to a DataFrame.  Nothing is collected to
the driver; Catalyst plans every operator.
"""

from lotquery.sources.tables import ParkingTables, load_tables, seed_tables
from lotquery.sources.derive import derive_tables

__all__ = ["ParkingTables", "load_tables", "seed_tables", "derive_tables"]
