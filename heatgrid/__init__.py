"""heatgrid: heat-health analytics as Spark DataFrame operators.

Every operator is a table-to-table (or stream-to-table) transformation:

* ``functions``  -- ``Column -> Column`` builders (physics, scaling, text, geo)
* ``sources``    -- readers, contracts and sinks
* ``operators``  -- ``DataFrame -> DataFrame`` jobs
* ``streaming``  -- Structured Streaming jobs over the same operators
* ``plans``      -- registered end-to-end queries and their SQL twins
"""

__version__ = "0.1.0"
