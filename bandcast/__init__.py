"""bandcast: a PySpark-native engine for road-traffic snapshot data.

Every operator is a plain ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function, parameterised by column names, so the same code runs on the
traffic tables and on the traffic-shaped fixture views over the driver tables.
"""

from bandcast.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
