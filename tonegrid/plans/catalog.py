"""All registered queries of the library, and their SQL."""

from tonegrid.plans import contours, governance, kernels, measurements, streams

QUERIES = {**governance.QUERIES, **contours.QUERIES, **measurements.QUERIES, **kernels.QUERIES, **streams.QUERIES}
ORACLES = {**governance.ORACLES, **contours.ORACLES, **measurements.ORACLES, **streams.ORACLES}
