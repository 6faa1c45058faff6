"""crosspanel: cross-sectional factor research as Spark DataFrame jobs.

Every public operator takes DataFrames and returns DataFrames.  Plans are lazy;
nothing in the package collects data to the driver.
"""

__version__ = "0.1.0"
