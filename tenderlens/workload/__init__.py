"""The given test tables bound to the roles of the contract table, and the
registered queries with their SQL counterparts."""
