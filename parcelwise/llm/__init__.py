"""Training-data operators: each module is one operator; `registry` holds their queries."""
