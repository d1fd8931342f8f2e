"""DataFrame operators: each takes DataFrames and a RoleSpec, and returns DataFrames."""
