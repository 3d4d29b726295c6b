"""Named queries over the domain and star-schema tables, each with SQL that says the same where SQL can."""
