"""Part of the reachability engine; see the README for the operator map."""
