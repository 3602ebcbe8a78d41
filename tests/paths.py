"""Where the given tables lie. Test modules import this by a name that no
other test folder uses, so the suite collects with and without tests/llm."""

SMOKE = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
