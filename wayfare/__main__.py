from wayfare.cli import main

main()
