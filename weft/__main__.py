from weft.cli import main

main()
