"""Where the test tables are."""

SMALL = "/root/testdata/sf0.001"
