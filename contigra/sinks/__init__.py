"""Writers: the null of a table is `NA`, numbers have fixed places, and files keep their order."""
