"""Tables: fixed schemas, snapshots, bulk maintenance, and the sample geography used by the registered queries."""
